"""The engine's functions by name in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="pos: int, type: tinyint, value: string")
class TokenRows:
    """gm_token_rows(text): a row for each token."""

    def eval(self, text: str):
        from glyphmill.operators.tokenize import walk

        if text is not None:
            for pos, (kind, value) in enumerate(walk(text.encode("utf-8").decode("latin-1"))):
                yield pos, kind, value


@F.udtf(returnType="seg_idx: int, start: int, end: int")
class SegmentRows:
    """gm_segment_rows(text): a row for each segment."""

    def eval(self, text: str):
        from glyphmill.operators.segment import pieces

        if text is not None:
            for i, p in enumerate(pieces(text)):
                yield i, p.start, p.end


def register(spark: SparkSession) -> list[str]:
    """Registers SQL functions, the Arrow functions of tokenizer and segmentation, and their table functions; returns
    the names."""
    sql = {
        "gm_byte_string": ("s STRING", "STRING", "decode(encode(s, 'UTF-8'), 'ISO-8859-1')"),
        "gm_from_byte_string": ("s STRING", "STRING", "make_valid_utf8(cast(encode(s, 'ISO-8859-1') as string))"),
        "gm_ascii_lower": ("s STRING", "STRING", "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
        "gm_and": ("a ARRAY<INT>, b ARRAY<INT>", "ARRAY<INT>", "array_sort(array_intersect(a, b))"),
        "gm_or": ("a ARRAY<INT>, b ARRAY<INT>", "ARRAY<INT>", "array_sort(array_union(a, b))"),
        "gm_xor": ("a ARRAY<INT>, b ARRAY<INT>", "ARRAY<INT>", "array_sort(array_union(array_except(a, b), array_except(b, a)))"),
        "gm_jaccard": ("a ARRAY<INT>, b ARRAY<INT>", "DOUBLE", "coalesce(size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0), double('NaN'))"),
    }
    for name, (args, out, body) in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")

    from ..operators.segment import pieces
    from ..operators.tokenize import TOKEN, walk

    @F.arrow_udf(f"array<{TOKEN}>")
    def tokens(a: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("type", pa.int8()), ("value", pa.string())]))
        return pa.array([None if t is None else [{"type": k, "value": v} for k, v in walk(t.encode("utf-8").decode("latin-1"))] for t in a.to_pylist()], kind)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def segments(a: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([None if t is None else [{"start": p.start, "end": p.end} for p in pieces(t)] for t in a.to_pylist()], kind)

    spark.udf.register("gm_tokens", tokens)
    spark.udf.register("gm_segments", segments)
    spark.udtf.register("gm_token_rows", TokenRows)
    spark.udtf.register("gm_segment_rows", SegmentRows)
    return [*sql, "gm_tokens", "gm_segments", "gm_token_rows", "gm_segment_rows"]
