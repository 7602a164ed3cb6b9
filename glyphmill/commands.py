"""The engine from a command line: python -m glyphmill.commands train | infer | dataset.

    train OUT INPUT...                     a dictionary from texts; OUT ending in .bin is binary, - is standard output
    infer DICTIONARY INPUT...              the parts of every token, a line each
    dataset DICTIONARY OUT INPUT...        signature files and their vocabulary (--scale, --radius)

INPUT is a path or URL of texts, or - for standard input.  A file name without a folder lies in the folder of --home.
Each command is a function that takes DataFrames, and returns its report as a dictionary.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytestr import KINDS, from_byte_string
from .operators import decompose, dictionary, frequency, tokenize, train
from .plans import pipelines
from .session import session, stored
from .sources import corpus, dictionaries, sig2

HOME = "dictionaries"  # where a bare file name lies


def placed_at(name: str, home: str = HOME) -> str:
    """The path a name stands for: itself if it has a folder or is -, else in the home folder."""
    bare = name != "-" and "/" not in name
    return str(PurePosixPath(home) / name) if bare else name


def form_of(path: str) -> str:
    """The form of a dictionary file, by its ending."""
    return "binary" if path.endswith(".bin") else "text"


def inputs(spark: SparkSession, names: list[str]) -> DataFrame:
    """Rows (doc_id, text) of the texts, in the order of the names."""
    out = None
    for name in names:
        if name == "-":
            one = spark.createDataFrame([("-", sys.stdin.read())], "path string, text string")
        else:
            one = corpus.read_text(spark, name)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("path").alias("doc_id"), "text")


def train_dictionary(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", **how: object) -> dict[str, int]:
    """Trains a dictionary, saves it unless out is empty, and reports tokens, size, passes and parts of each kind."""
    tokens = stored(tokenize.tokenize(docs, key, text), "tokens")
    totals = frequency.totals(tokens).first()
    got = train.train(frequency.frequencies(tokens, tokenize.WORD), frequency.frequencies(tokens, tokenize.DELIMITER), **how)
    if out == "-":
        sys.stdout.write(dictionaries.to_text(got.parts))
    elif out:
        dictionaries.save(got.parts, out, form_of(out))
    report = {"inputs": docs.count(), "tokens": totals["tokens"], "words": totals["words"], "delimiters": totals["delimiters"], "size": len(got.parts), "passes": got.passes}
    return report | {name: sum(kind == k for kind, _ in got.parts) for k, name in enumerate(KINDS)}


def infer_parts(docs: DataFrame, parts: list[dictionary.Part], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, pos, line) of every token with its parts, as a person reads them."""
    table = dictionary.frame(docs.sparkSession, parts)
    lines = decompose.listing(pipelines.decomposed(docs, table, key, text), table, key)
    return lines.select(key, "pos", from_byte_string(F.col("line")).alias("line"))


def build_dataset(docs: DataFrame, parts: list[dictionary.Part], out: str, scale: str = "both", radius: int | None = None, key: str = "doc_id", text: str = "text") -> dict[str, int]:
    """Writes the signature files of the texts into a folder; reports scopes, records, files, size and words."""
    table = dictionary.frame(docs.sparkSession, parts)
    got, words = pipelines.signatures(docs, table, scale, radius, key, text)
    got, words = stored(got, "signatures"), stored(words.select("word_id", from_byte_string(F.col("word")).alias("word")), "vocabulary")
    rows = got.select(F.monotonically_increasing_id().alias("idx"), F.col("scale").cast("int").alias("scale"), "cur_word", "next_word", "L", "C", "R")
    files = sig2.write(rows, words, len(parts), out)
    scopes = {r["scale"]: r["n"] for r in got.select(key, "scale", "scope_idx").distinct().groupBy("scale").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"sentences": scopes.get(pipelines.SENTENCE, 0), "paragraphs": scopes.get(pipelines.PARAGRAPH, 0), "records": got.count(), "files": files, "size": len(parts), "words": words.count()}


def load(name: str, home: str = HOME) -> list[dictionary.Part]:
    path = placed_at(name, home)
    return dictionaries.load(path, form_of(path))


def main(args: list[str] | None = None) -> dict[str, int] | None:
    p = argparse.ArgumentParser(prog="glyphmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("train", "infer", "dataset"))
    p.add_argument("names", nargs="+")
    p.add_argument("--home", default=HOME)
    p.add_argument("--scale", choices=("both", "sentence", "paragraph"), default="both")
    p.add_argument("--radius", type=int)
    a = p.parse_args(args)
    if len(a.names) < (3 if a.command == "dataset" else 2):
        p.error("too few names")
    spark = session()
    report = None
    if a.command == "train":
        report = train_dictionary(inputs(spark, a.names[1:]), placed_at(a.names[0], a.home))
    elif a.command == "infer":
        for r in infer_parts(inputs(spark, a.names[1:]), load(a.names[0], a.home)).orderBy("doc_id", "pos").toLocalIterator():
            print(r["line"])
    else:
        report = build_dataset(inputs(spark, a.names[2:]), load(a.names[0], a.home), placed_at(a.names[1], a.home), a.scale, a.radius)
    for k, v in (report or {}).items():
        print(f"{k}: {v}", file=sys.stderr)
    return report


__all__ = ["build_dataset", "form_of", "infer_parts", "inputs", "load", "main", "placed_at", "train_dictionary"]

if __name__ == "__main__":
    main()
