"""The engine's pipelines from texts to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytestr import from_byte_string, to_byte_string
from ..functions.intervals import extract
from ..operators import decompose, frequency, sections, segment, signature, tokenize, train
from ..session import stored

SENTENCE, PARAGRAPH = 0, 1


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: object) -> train.Trained:
    """A dictionary trained on all texts."""
    tokens = tokenize.tokenize(docs, key, text)
    return train.train(frequency.frequencies(tokens, tokenize.WORD), frequency.frequencies(tokens, tokenize.DELIMITER), **how)


def decomposed(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every token of every text with its parts: (key, pos, type, value, part_ids)."""
    return decompose.token_parts(tokenize.tokenize(docs, key, text), dictionary)


def top_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The frequent words that the adaptive cut keeps: (rank, word, freq)."""
    freq = frequency.frequencies(tokenize.tokenize(docs, key, text), tokenize.WORD).withColumn("kind", F.lit(0))
    kept = frequency.ranked_head(freq, ["kind"])
    return kept.select("rank", from_byte_string(F.col("value")).alias("word"), "freq")


def scopes(docs: DataFrame, scale: str = "both", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, scale, scope_idx, bytes) of the sentences (scale 0) and paragraphs (scale 1) of each text."""
    parts = []
    if scale in ("both", "sentence"):
        s = docs.select(key, F.col(text).alias("__t"), F.posexplode(segment.segment_column(F.col(text))).alias("scope_idx", "s"))
        parts.append(s.select(key, F.lit(SENTENCE).cast("tinyint").alias("scale"), "scope_idx", to_byte_string(extract(F.col("__t"), F.col("s"))).alias("bytes")))
    if scale in ("both", "paragraph"):
        p = sections.paragraphs(sections.section_nodes(docs, key, text), key)
        p = p.withColumn("scope_idx", F.row_number().over(Window.partitionBy(key).orderBy("node_id")) - 1)
        p = p.join(docs.select(key, F.col(text).alias("__t")), key)
        parts.append(p.select(key, F.lit(PARAGRAPH).cast("tinyint").alias("scale"), "scope_idx", to_byte_string(extract(F.col("__t"), F.struct("start", "end"))).alias("bytes")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def scope_words(docs: DataFrame, scale: str = "both", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, scale, scope_idx, word_pos, value): the words of every scope in order."""
    each = scopes(docs, scale, key, text).select(key, "scale", "scope_idx", F.posexplode(tokenize.byte_tokens(F.col("bytes"))).alias("at", "t"))
    words = each.where(F.col("t.type") == tokenize.WORD)
    w = Window.partitionBy(key, "scale", "scope_idx").orderBy("at")
    return words.select(key, "scale", "scope_idx", (F.row_number().over(w) - 1).alias("word_pos"), F.col("t.value").alias("value"))


def signatures(docs: DataFrame, dictionary: DataFrame, scale: str = "both", radius: int | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The records (key, scale, scope_idx, word_pos, cur_word, next_word, L, C, R) of all words, and the vocabulary.

    Each distinct word is decomposed once. Words are numbered by where they are first seen: by document, sentences
    before paragraphs.
    """
    words = stored(scope_words(docs, scale, key, text), "words")
    vocabulary = signature.vocabulary(words, [key, "scale", "scope_idx", "word_pos"])
    bags = decompose.decompose(words.select(F.col("value").alias("word")), dictionary).select(F.col("word").alias("value"), "bag")
    scope = [key, "scale", "scope_idx"]
    labelled = words.join(vocabulary.select(F.col("word").alias("value"), F.col("word_id").alias("cur_word")), "value").join(bags, "value", "left")
    labelled = labelled.withColumn("next_word", signature.next_label("cur_word", scope, "word_pos"))
    got = signature.encode(labelled, scope, "word_pos", "bag", radius)
    return got.select(*scope, "word_pos", "cur_word", "next_word", "L", "C", "R"), vocabulary
