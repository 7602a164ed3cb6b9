"""Words and delimiters of texts, byte by byte.

A text without an apostrophe is cut by one regular expression inside the JVM.  An apostrophe makes later decisions
depend on whether a quotation is open; such texts go through an Arrow function that walks over the same runs and keeps
that one bit.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytestr import ascii_lower, punctuation_class, to_byte_string, whitespace_class

WORD, DELIMITER = 0, 1
TOKEN = "struct<type:tinyint,value:string>"

_PREFIX = r"(?:[-+][$]?|[$])(?=[0-9])"
_OPEN = rf"(?:(?<![A-Za-z0-9]){_PREFIX}|[A-Za-z](?:\.(?=[A-Za-z0-9]))?|[0-9])"
_GO_ON = r"(?:[A-Za-z0-9]|[-&](?=[A-Za-z0-9])|(?<=[0-9])[,.](?=[0-9])|(?<=\.[A-Za-z])\.(?=[A-Za-z0-9]))*+"
_SPACE = r"[ \t\r\n]++"
_PUNCT = r"(?:-++|[^A-Za-z0-9 \t\r\n])(?:(?!(?:[-+][$]?|[$])[0-9])[^A-Za-z0-9 \t\r\n])*+"
PATTERN = f"{_OPEN}{_GO_ON}|{_SPACE}|{_PUNCT}"
_RUN = re.compile(f"(?P<word>{_OPEN}{_GO_ON.replace('[-&]', '''[-&']''')})|(?P<space>{_SPACE})|(?P<punct>{_PUNCT})")


def walk(text: str) -> list[tuple[int, str]]:
    """Type and value of each token of a byte string."""
    out: list[tuple[int, str]] = []
    at, quoted = 0, False
    while m := _RUN.match(text, at):
        run, at = m.group(), m.end()
        if m.lastgroup == "word":
            if not quoted and text.startswith("'", at):  # no letter follows, else it were inside the word
                run, at = run + "'", at + 1
            out.append((WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)))
        elif m.lastgroup == "space":
            feeds = run.count("\n")
            out.append((DELIMITER, "\n\n" if feeds > 1 else "\n" if feeds else " " if run == " " else "\t"))
        else:
            quoted ^= run.count("'") % 2 == 1
            same = len(set(run)) == 1
            out.append((DELIMITER, "..." if same and run[0] == "." and len(run) > 2 else "--" if same and run[0] == "-" and len(run) > 1 else run))
    return out


def _walked(bytes_: Column) -> Column:
    """The tokens by walk()."""

    @F.arrow_udf(f"array<{TOKEN}>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("type", pa.int8()), ("value", pa.string())]))
        return pa.array([None if t is None else [{"type": k, "value": v} for k, v in walk(t)] for t in texts.to_pylist()], kind)

    return run(bytes_)


def byte_tokens(bytes_: Column) -> Column:
    """Array of tokens (type, value) of a byte string. Null gives null, the empty string an empty array."""
    quote = bytes_.contains("'")

    def token(run: Column) -> Column:
        head = F.substring(run, 1, 1)
        space = head.rlike("[ \t\r\n]")
        word = ~space & (head.rlike("[A-Za-z0-9]") | run.rlike(r"^[-+]?[$]?[0-9]"))
        value = F.when(word, ascii_lower(run)).when(space, whitespace_class(run)).otherwise(punctuation_class(run))
        return F.struct(F.when(word, F.lit(WORD)).otherwise(F.lit(DELIMITER)).cast("tinyint").alias("type"), value.alias("value"))

    plain = F.transform(F.regexp_extract_all(F.when(~quote, bytes_), F.lit(PATTERN), F.lit(0)), token).cast(f"array<{TOKEN}>")
    return F.coalesce(plain, _walked(F.when(quote, bytes_)))


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, pos, type, value), a row for each token of each text; values are byte strings.

    A null or empty text gives no rows. Other columns are ignored.
    """
    bytes_ = docs.select(F.col(key), to_byte_string(F.col(text)).alias("__b"))
    tokens = bytes_.select(key, F.posexplode(byte_tokens(F.col("__b"))).alias("pos", "__t"))
    return tokens.select(key, "pos", F.col("__t.type").alias("type"), F.col("__t.value").alias("value"))
