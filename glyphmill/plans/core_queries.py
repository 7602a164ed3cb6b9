"""Queries on the project's tables for the engine's own operators, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytestr as B
from ..functions import intervals as R
from ..functions import sparse as P
from ..functions import threshold as A
from ..functions.register import register
from ..operators import decompose, dictionary, frequency, sections, segment, signature, skew, tokenize, train
from ..session import shared_folder, spread, stored
from ..sources import dictionaries, sig2
from ..streaming import frequency as streaming
from . import pipelines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


# ---- texts to frequencies


@query()
def top_words(s: SparkSession, d: str) -> DataFrame:
    return pipelines.top_words(table(s, d, "documents"))


@query()
def document_tokens(s: SparkSession, d: str) -> DataFrame:
    return tokenize.tokenize(table(s, d, "documents"))


LETTERS = "regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')"


def _letters(s: SparkSession, d: str) -> DataFrame:
    """Tokens of the documents with all but letters blanked out."""
    return tokenize.tokenize(table(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]+", " ").alias("text")))


@query(f"select doc_id, lower(w) as value, count(*) as n from (select doc_id, unnest(regexp_extract_all({LETTERS}, '[A-Za-z]+')) as w from documents where text is not null) group by 1, 2")
def letter_words(s: SparkSession, d: str) -> DataFrame:
    return _letters(s, d).where("type = 0").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with w as (select unnest(regexp_extract_all({LETTERS}, '[A-Za-z]+')) as w from documents), b as (select unnest(regexp_extract_all({LETTERS}, ' +')) as w from documents)
select (select count(*) from w) as words, (select count(distinct lower(w)) from w) as distinct_words, (select count(*) from b) as delimiters, (select count(*) from w) + (select count(*) from b) as tokens"""
)
def token_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of the letters only, as far as SQL can count them; text_totals() has those of the texts."""
    return frequency.totals(_letters(s, d))


@query()
def text_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of the texts as they are."""
    return frequency.totals(tokenize.tokenize(table(s, d, "documents")))


ONE_TOKEN = "(select m.* from (select arg_max(struct_pack(tok_type := tok_type, tok_value := tok_value), loaded_at) as m from tokens where tok_id is not null group by tok_id))"
TOKENS = f"(select tok_type, tok_value as value, count(*) as freq from {ONE_TOKEN} where tok_value is not null and tok_value <> '' group by 1, 2)"


def _token_freq(s: SparkSession, d: str) -> DataFrame:
    """Frequencies of the values by type, each token once."""
    one = skew.once(table(s, d, "tokens"), "tok_id", ["tok_type", "tok_value"], "loaded_at")
    return one.where("tok_value is not null and tok_value <> ''").groupBy("tok_type", F.col("tok_value").alias("value")).agg(F.count(F.lit(1)).alias("freq"))


@query(f"select tok_type, value, freq, row_number() over (partition by tok_type order by freq desc, value) as rank from {TOKENS}")
def value_ranks(s: SparkSession, d: str) -> DataFrame:
    return frequency.ranked(_token_freq(s, d), ["tok_type"]).select("tok_type", "value", "freq", F.col("rank").cast("long"))


CUT = """
w as (select *, count(*) over g as n, max(v) over g as first_v, min(v) over g as last_v, sum(v) over g as total, sum(v) over (partition by grp order by rk) as cum from x window g as (partition by grp)),
p as (select *, case when rk > 1 and rk < n then first_v + ((rk - 1)::double / (n - 1)) * (last_v - first_v) - v end as depth,
  case when n % 2 = 1 and rk - 1 = n // 2 then v when n % 2 = 0 and (rk - 1 = n // 2 or rk - 1 = n // 2 - 1) then 0.5 * v end as mid from w),
q as (select grp, any_value(n) as n, any_value(first_v) as first_v, any_value(last_v) as last_v, any_value(total) as total, max(depth) as depth, sum(mid) as med, min(case when cum >= 0.5 * total then rk end) as mm from p group by grp),
e as (select q.*, (select min(rk) - 1 from p where p.grp = q.grp and p.depth = q.depth) as bend from q),
c as (select grp, n, total, case when n >= 3 and first_v - last_v > 1e-12 and depth > 0 and depth >= 0.01 * med then bend else n end as elbow,
  case when not total > 0 then n else greatest(least(ceil(2.2 * coalesce(mm, n)), n), 1) end as scaled from e)"""


@query(
    f"""with x as (select tok_type as grp, value, freq::double as v, row_number() over (partition by tok_type order by freq desc, value) as rk from {TOKENS}), {CUT}
select x.grp as tok_type, x.value as value, x.v::bigint as freq from x join c on x.grp is not distinct from c.grp where x.rk <= case when c.elbow < c.n then c.elbow else c.scaled end"""
)
def pruned_values(s: SparkSession, d: str) -> DataFrame:
    return frequency.pruned(_token_freq(s, d), ["tok_type"]).select("tok_type", "value", "freq")


@query(
    f"""with x as (select l_orderkey as grp, l_extendedprice as v, row_number() over (partition by l_orderkey order by l_extendedprice desc) as rk from lineitem), {CUT}
select grp as l_orderkey, elbow::int as elbow, scaled::int as median, (case when elbow < n then elbow else scaled end)::int as prune,
  coalesce((select v from x where x.grp = c.grp and rk = (case when c.elbow < c.n then c.elbow else c.scaled end) + 1), 0) as threshold from c"""
)
def cuts(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_extendedprice"), False).alias("v"))
    x = F.col("v")
    return v.select("l_orderkey", A.elbow_count(x).alias("elbow"), A.median_count(x).alias("median"), A.prune_count(x).alias("prune"), A.prune_threshold(x).alias("threshold"))


@query(
    """with x as (select l_orderkey as k, l_quantity as v, row_number() over (partition by l_orderkey order by l_quantity desc) as rk from lineitem),
e as (select k, count(*) as n, ln(sum(v)) + sum(-v * ln(v)) / sum(v) as h from x where v > 0 group by k),
g as (select k, rk, lag(v) over (partition by k order by rk) / v as ratio from x),
m as (select k, max(ratio) as top from g where rk > 1 group by k)
select e.k as l_orderkey, round(exp(h), 6) as effective, case when m.top is null then 1 when m.top < 1.5 then e.n else (select min(rk) - 1 from g where g.k = e.k and g.ratio = m.top) end::int as gap from e left join m on e.k = m.k"""
)
def entropy_and_gap(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity"), False).alias("v"))
    x = F.col("v")
    return v.select("l_orderkey", F.round(A.effective_count(x), 6).alias("effective"), A.gap_count(x).alias("gap"))


@query()
def entropy_counts(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity"), False).alias("v"))
    return v.select("l_orderkey", A.entropy_count(F.col("v")).alias("k"))


# ---- bytes and strings


@query("select doc_id, strlen(text) as bytes, text as again from documents where text is not null")
def byte_strings(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "documents").where("text is not null").select("doc_id", B.to_byte_string(F.col("text")).alias("b"))
    return b.select("doc_id", F.length("b").cast("long").alias("bytes"), B.from_byte_string(F.col("b")).alias("again"))


@query("select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents where text is not null")
def ascii_lowered(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", B.ascii_lower(F.col("text")).alias("low"))


@query(
    """select tok_id, case when c in (' ', chr(9), chr(13), chr(10)) then 'space' when regexp_full_match(c, '[A-Za-z0-9]') then 'word' else 'punct' end as class
from (select distinct tok_id, substr(tok_value, 1, 1) as c from tokens where tok_value <> '')"""
)
def byte_classes(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "tokens").where("tok_value <> ''").select("tok_id", F.substring("tok_value", 1, 1).alias("c")).distinct()
    return c.select("tok_id", B.byte_class(F.col("c")).alias("class"))


@query("select tok_id, case when regexp_matches(tok_value, '^[-+][$][0-9]') then 2 when regexp_matches(tok_value, '^[-+$][0-9]') then 1 else 0 end as n from (select distinct tok_id, tok_value from tokens where tok_value is not null)")
def number_prefixes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tokens").where("tok_value is not null").select("tok_id", "tok_value").distinct().select("tok_id", B.number_prefix(F.col("tok_value")).alias("n"))


@query(
    """select doc_id, run, case when length(run) - length(replace(run, chr(10), '')) >= 2 then chr(10) || chr(10) when contains(run, chr(10)) then chr(10) when run = ' ' then ' ' else chr(9) end as class, count(*) as n
from (select doc_id, unnest(regexp_extract_all(text, '[ \\t\\r\\n]+')) as run from documents where text is not null) group by all"""
)
def whitespace_runs(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[ \t\r\n]+"), F.lit(0))).alias("run"))
    return r.groupBy("doc_id", "run", B.whitespace_class(F.col("run")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select doc_id, run, case when regexp_full_match(run, '[.]{3,}') then '...' when regexp_full_match(run, '-{2,}') then '--' else run end as class, count(*) as n
from (select doc_id, unnest(regexp_extract_all(text, '[^A-Za-z0-9 \\t\\r\\n]+')) as run from documents where text is not null) group by all"""
)
def punctuation_runs(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^A-Za-z0-9 \t\r\n]+"), F.lit(0))).alias("run"))
    return r.groupBy("doc_id", "run", B.punctuation_class(F.col("run")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct tok_value as value, replace(replace(replace(replace(tok_value, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') as written from tokens where tok_value is not null")
def escaped_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tokens").where("tok_value is not null").select(F.col("tok_value").alias("value")).distinct().select("value", B.escape(F.col("value")).alias("written"))


@query("select part_id, case part_kind when 0 then 'start' when 1 then 'end' when 2 then 'mid' when 3 then 'letter' when 4 then 'whole' when 5 then 'delim' end as name, part_kind::int as number from part_dict")
def kind_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part_dict").select("part_id", B.kind_name(F.col("part_kind")).alias("name")).withColumn("number", B.kind_number(F.col("name")))


@query("select word_id, case when word_id * 40 <= 65536 then 16 else 32 end as bits from vocab")
def id_widths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vocab").select("word_id", B.sparse_width(F.col("word_id") * 40).alias("bits"))


@query("select tok_id, lower(tok_value) in ('" + "', '".join(sorted(segment.STOP_WORDS)) + "') as stop from (select distinct tok_id, tok_value from tokens where tok_value is not null)")
def stop_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tokens").where("tok_value is not null").select("tok_id", "tok_value").distinct().select("tok_id", F.lower("tok_value").isin(*sorted(segment.STOP_WORDS)).alias("stop"))


# ---- sparse sets

ONE_SIGNATURE = """(select rec_id, list_sort(list_distinct(coalesce(m.l, []))) as a, list_sort(list_distinct(coalesce(m.c, []))) as c, list_sort(list_distinct(coalesce(m.r, []))) as b, m.scale, m.cur_word, m.next_word
  from (select rec_id, arg_max(struct_pack(l := l, c := c, r := r, scale := scale, cur_word := cur_word, next_word := next_word), loaded_at) as m from signatures where rec_id is not null group by rec_id))"""


def _sets(s: SparkSession, d: str) -> DataFrame:
    """rec_id and the sets a (left), c (own), b (right), each record once."""
    t = skew.once(table(s, d, "signatures"), "rec_id", ["l", "c", "r"], "loaded_at")
    return t.select("rec_id", *[P.as_set(F.col(x)).alias(y) for x, y in (("l", "a"), ("c", "c"), ("r", "b"))])


def _text(ids) -> F.Column:
    return F.array_join(ids.cast("array<string>"), ",")


@query(
    f"""select rec_id, array_to_string(list_sort(list_intersect(a, b)), ',') as both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as either,
  array_to_string(list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: list_contains(a, x) <> list_contains(b, x))), ',') as one from {ONE_SIGNATURE}"""
)
def sparse_sets(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _sets(s, d).select("rec_id", _text(P.intersection(a, b)).alias("both"), _text(P.union(a, b)).alias("either"), _text(P.symmetric_difference(a, b)).alias("one"))


@query(
    f"""select rec_id, i::int as n_and, (x + y - i)::int as n_or, (x + y - 2 * i)::int as n_xor, case when x + y - i = 0 then 'NaN'::double else i / (x + y - i) end as jaccard
from (select rec_id, len(list_intersect(a, b)) as i, len(a) as x, len(b) as y from {ONE_SIGNATURE})"""
)
def sparse_counts(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _sets(s, d).select("rec_id", P.intersection_size(a, b).alias("n_and"), P.union_size(a, b).alias("n_or"), P.difference_size(a, b).alias("n_xor"), P.jaccard(a, b).alias("jaccard"))


@query(
    f"""select rec_id, array_to_string(list_concat(a, list_transform(c, lambda x: x + 2000), list_transform(b, lambda x: x + 4000)), ',') as flat,
  array_to_string(list_concat(a, list_transform(b, lambda x: x + 2000)), ',') as lr, array_to_string(list_sort(list_distinct(list_concat(a, c))), ',') as seen from {ONE_SIGNATURE}"""
)
def flat_signatures(s: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _sets(s, d).select("rec_id", _text(P.flatten_bands([a, c, b], 2000)).alias("flat"), _text(P.flatten_bands([a, b], 2000)).alias("lr"), _text(signature.band_union(a, c)).alias("seen"))


@query(f"select rec_id, array_to_string(list_transform(a, lambda x, i: x - coalesce(a[i - 1], 0)), ',') as gaps, array_to_string(a, ',') as again from {ONE_SIGNATURE}")
def id_gaps(s: SparkSession, d: str) -> DataFrame:
    g = _sets(s, d).select("rec_id", P.gaps(F.col("a")).alias("g"))
    return g.select("rec_id", _text(F.col("g")).alias("gaps"), _text(P.from_gaps(F.col("g"))).alias("again"))


# ---- dictionary


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part_dict").select("part_id", F.col("part_kind").cast("int").alias("kind"), F.col("part_value").alias("value"))


@query("select v.word_id, v.word, w.part_id as whole, s.part_id as start from vocab v left join part_dict w on w.part_kind = 4 and w.part_value = v.word left join part_dict s on s.part_kind = 0 and s.part_value = substr(v.word, 1, 3)")
def part_lookup(s: SparkSession, d: str) -> DataFrame:
    v, p = table(s, d, "vocab").select("word_id", "word"), _parts(s, d)
    whole = dictionary.lookup(v.select("word_id", "word", F.lit(B.WHOLE).alias("kind"), F.col("word").alias("value")), p, "whole").select("word_id", "word", "whole")
    return dictionary.lookup(whole.select("*", F.lit(B.START).alias("kind"), F.substring("word", 1, 3).alias("value")), p, "start").select("word_id", "word", "whole", "start")


@query("select word_id, pos, part_id, part_kind::int as kind, part_value as value from (select word_id, unnest(bag) as part_id, generate_subscripts(bag, 1) - 1 as pos from vocab) left join part_dict using (part_id)")
def bag_parts(s: SparkSession, d: str) -> DataFrame:
    each = table(s, d, "vocab").select("word_id", F.posexplode("bag").alias("pos", "part_id"))
    return dictionary.at(each, _parts(s, d)).select("word_id", F.col("pos").cast("long").alias("pos"), "part_id", "kind", "value")


@query("select part_kind::int as kind, case part_kind when 0 then 'start' when 1 then 'end' when 2 then 'mid' when 3 then 'letter' when 4 then 'whole' else 'delim' end as name, count(*) as n from part_dict group by 1, 2")
def part_counts(s: SparkSession, d: str) -> DataFrame:
    return dictionary.counts(_parts(s, d))


@query("select word_id, word from vocab where word in (select part_value from part_dict where part_kind = 4)")
def whole_words(s: SparkSession, d: str) -> DataFrame:
    return dictionary.has(table(s, d, "vocab").select("word_id", "word"), _parts(s, d), B.WHOLE, "word")


@query(
    """select part_id, part_kind::int as kind, part_value as value from part_dict
union all select (select max(part_id) from part_dict) + row_number() over (order by id), 4, word from (select word, min(word_id) as id from vocab where word not in (select part_value from part_dict where part_kind = 4) group by word)"""
)
def grown_dictionary(s: SparkSession, d: str) -> DataFrame:
    new = table(s, d, "vocab").select(F.lit(B.WHOLE).alias("kind"), F.col("word").alias("value"), "word_id")
    return dictionary.add(_parts(s, d), new, ["word_id"])


@query(
    """select part_id, part_kind = 3 or (length(part_value) = 1 and ((part_kind = 4 and regexp_matches(part_value, '^[a-z0-9&,.$''-]$')) or (part_kind = 5 and regexp_matches(part_value, '^[&,.$''-]$')))) as atom,
  case part_kind when 0 then part_value || '##' when 2 then '##' || part_value || '##' when 1 then '##' || part_value else part_value end as line from part_dict"""
)
def dictionary_lines(s: SparkSession, d: str) -> DataFrame:
    kind, value = F.col("kind"), F.col("value")
    return _parts(s, d).select("part_id", dictionary.atom_column(kind, value).alias("atom"), dictionary.listed_column(kind, value).alias("line"))


@query("select part_kind::int as kind, part_value as value from part_dict where part_kind <> 3")
def dictionary_files(s: SparkSession, d: str) -> DataFrame:
    """The table through the text form and the binary form; parts that both give back, which is all but bare letters."""
    parts = dictionary.parts_of(_parts(s, d).where(F.col("kind") != B.LETTER))
    text, raw = dictionaries.from_text(dictionaries.to_text(parts)), dictionaries.from_bytes(dictionaries.to_bytes(parts))
    return dictionary.frame(s, [p for p in parts if p in set(text) and p in set(raw)]).select("kind", "value")


@query("select s as kind_value from (select unnest(list_concat(list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789-''&,.$', ''), lambda c: '4' || c), list_transform(string_split('-''&,.$', ''), lambda c: '5' || c))) as s)")
def atom_parts(s: SparkSession, d: str) -> DataFrame:
    atoms = dictionary.frame(s, dictionary.atoms())
    return atoms.where("kind <> 3").select(F.concat(F.col("kind").cast("string"), "value").alias("kind_value"))


# ---- words into parts

WINDOWS = """(select word, length(word) as n, unnest(range(2, least(7, length(word)) + 1)) as len from (select distinct word from vocab))"""
PIECES = f"""(select word, len, 0 as pos, 0 as kind from {WINDOWS} union all select word, len, n - len, 1 from {WINDOWS} union all select word, len, unnest(range(0, n - len + 1)), 2 from {WINDOWS})"""


@query(f"select word, part_id as id, pos::int as pos, len::int as len, kind::int as kind from {PIECES} join part_dict on part_kind = kind and part_value = substr(word, (pos + 1)::bigint, len::bigint)")
def part_candidates(s: SparkSession, d: str) -> DataFrame:
    return decompose.candidates(table(s, d, "vocab").select("word").distinct(), _parts(s, d))


@query()
def word_parts(s: SparkSession, d: str) -> DataFrame:
    return decompose.decompose(table(s, d, "vocab"), _parts(s, d)).select("word", _text(F.col("part_ids")).alias("part_ids"), _text(F.col("bag")).alias("bag"))


@query()
def free_runs(s: SparkSession, d: str) -> DataFrame:
    return decompose.free_runs(table(s, d, "vocab"), _parts(s, d))


@query(
    """with v as (select distinct tok_value as value from tokens where tok_type = 1 and tok_value <> ''), p as (select part_value, part_id from part_dict where part_kind = 5),
c as (select value, i, substr(value, i, 1) as ch from (select value, unnest(range(1, length(value) + 1)) as i from v where value not in (select part_value from p)))
select v.value, coalesce(p.part_id::varchar, (select string_agg(q.part_id, ',' order by i) from c join p q on q.part_value = c.ch where c.value = v.value), '') as part_ids from v left join p on p.part_value = v.value"""
)
def delimiter_parts(s: SparkSession, d: str) -> DataFrame:
    return decompose.decompose_delimiters(table(s, d, "tokens").where("tok_type = 1").select(F.col("tok_value").alias("value")), _parts(s, d)).select("value", _text(F.col("part_ids")).alias("part_ids"))


@query()
def token_listing(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    return decompose.listing(pipelines.decomposed(table(s, d, "documents"), p), p, "doc_id")


@query()
def trained_parts(s: SparkSession, d: str) -> DataFrame:
    freq = _token_freq(s, d)
    word, mark = (freq.where(f"tok_type = {k}").select(B.to_byte_string(F.col("value")).alias("value"), "freq") for k in (0, 1))
    return dictionary.frame(s, train.train(word, mark).parts)


# ---- signatures

def _words(s: SparkSession, d: str) -> DataFrame:
    """Words in their scopes with their bags; a place that several rows name holds the least of their words."""
    t = table(s, d, "signatures").groupBy(*SCOPE, "word_pos").agg(F.min("cur_word").alias("cur_word"))
    return t.join(table(s, d, "vocab").select(F.col("word_id").alias("cur_word"), "bag"), "cur_word")


SCOPE = ["doc_id", "scale", "scope_idx"]
PLACES = "(select doc_id, scale, scope_idx, word_pos, cur_word, list_sort(list_distinct(bag)) as bag from (select doc_id, scale, scope_idx, word_pos, min(cur_word) as cur_word from signatures group by all) join vocab on cur_word = word_id)"


def _sides(before: str, after: str) -> str:
    flat = "array_to_string(list_sort(list_distinct(coalesce(flatten(list(bag) over (w {})), []))), ',')"
    return f"""select doc_id, scale, scope_idx, word_pos, {flat.format(before)} as l, array_to_string(bag, ',') as c, {flat.format(after)} as r
from {PLACES} window w as (partition by doc_id, scale, scope_idx order by word_pos)"""


@query(_sides("rows between unbounded preceding and 1 preceding", "rows between 1 following and unbounded following"))
def word_signatures(s: SparkSession, d: str) -> DataFrame:
    got = signature.encode(_words(s, d), SCOPE, "word_pos")
    return got.select(*SCOPE, "word_pos", _text(F.col("L")).alias("l"), _text(F.col("C")).alias("c"), _text(F.col("R")).alias("r"))


@query(_sides("rows between 3 preceding and 1 preceding", "rows between 1 following and 3 following"))
def near_signatures(s: SparkSession, d: str) -> DataFrame:
    got = signature.encode(_words(s, d), SCOPE, "word_pos", radius=3)
    return got.select(*SCOPE, "word_pos", _text(F.col("L")).alias("l"), _text(F.col("C")).alias("c"), _text(F.col("R")).alias("r"))


@query(f"select doc_id, scale, scope_idx, word_pos, cur_word, lead(cur_word) over (partition by doc_id, scale, scope_idx order by word_pos) as next_word from {PLACES}")
def next_words(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select(*SCOPE, "word_pos", "cur_word", signature.next_label("cur_word", SCOPE, "word_pos").alias("next_word"))


@query("select (row_number() over (order by f, value) - 1)::int as word_id, value as word from (select tok_value as value, min(struct_pack(a := doc_id, b := tok_pos)) as f from tokens where tok_type = 0 and tok_value is not null group by 1)")
def word_ids(s: SparkSession, d: str) -> DataFrame:
    return signature.vocabulary(table(s, d, "tokens").where("tok_type = 0"), ["doc_id", "tok_pos"], "tok_value")


@query()
def signature_records(s: SparkSession, d: str) -> DataFrame:
    got, _ = pipelines.signatures(table(s, d, "documents"), _parts(s, d))
    return got.select(*SCOPE, "word_pos", "cur_word", "next_word", *[_text(F.col(x)).alias(x.lower()) for x in "LCR"])


@query(f"select rec_id, scale::int as scale, cur_word, word, next_word, array_to_string(a, ',') as l, array_to_string(c, ',') as c, array_to_string(b, ',') as r from {ONE_SIGNATURE} left join vocab on cur_word = word_id")
def signature_files(s: SparkSession, d: str) -> DataFrame:
    """The records and the vocabulary written to SIG2 files and read again."""
    path = f"{shared_folder(s)}/sig2-{uuid.uuid4().hex}"
    once = skew.once(table(s, d, "signatures"), "rec_id", ["scale", "cur_word", "next_word", "l", "c", "r"], "loaded_at")
    rows = once.select(F.col("rec_id").alias("idx"), F.col("scale").cast("int").alias("scale"), "cur_word", "next_word", *[P.as_set(F.col(x.lower())).alias(x) for x in "LCR"])
    rows = stored(rows, "records")
    sig2.write(rows, table(s, d, "vocab"), 2000, path)
    numbers = rows.select(F.col("idx").alias("rec_id"), F.struct("scale", "cur_word", "next_word", "L", "C", "R").alias("x"))
    back = sig2.read(s, path)
    got = back.select("scale", "cur_word", "next_word", *[_text(F.col(x)).alias(x.lower()) for x in "LCR"])
    same = numbers.select("rec_id", F.col("x.scale").cast("int").alias("scale"), "x.cur_word", "x.next_word", *[_text(F.col(f"x.{x}")).alias(x.lower()) for x in "LCR"])
    w = Window.partitionBy("scale", "cur_word", "next_word", "l", "c", "r").orderBy(F.lit(1))
    cols = ["scale", "cur_word", "next_word", "l", "c", "r"]
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*cols, "i")]
    g, n = got.withColumn("i", F.row_number().over(w)).alias("g"), same.withColumn("i", F.row_number().over(w)).alias("n")
    words = sig2.read_words(s, path).groupBy(F.col("word_id").alias("cur_word")).agg(B.from_byte_string(F.first("word")).alias("word"))
    return g.join(n, on).select("n.rec_id", *[F.col(f"g.{c}").alias(c) for c in cols]).join(words, "cur_word", "left")


# ---- segments and trees


@query()
def document_segments(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(table(s, d, "documents"), headers=True)


@query()
def inner_ranges(s: SparkSession, d: str) -> DataFrame:
    return segment.subsegments(table(s, d, "documents"), original=True)


@query()
def range_inner(s: SparkSession, d: str) -> DataFrame:
    """Ranges inside the segments that an earlier run left, and inside the sections of the texts."""
    t = table(s, d, "documents").select("doc_id", "text")
    old = _clamped(s, d).select("doc_id", F.lit("segment").alias("of"), F.col("seg_idx").alias("n"), F.col("a.start").alias("start"), F.col("a.end").alias("end"))
    nodes = sections.section_nodes(t).where("node_type = 'section'").select("doc_id", F.lit("section").alias("of"), F.col("node_id").alias("n"), "start", "end")
    return segment.subsegments_of(old.union(nodes).join(t, "doc_id"), ["doc_id", "of", "n"], original=True)


@query()
def protected_spans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.explode(segment.protected_spans(F.col("text"))).alias("p")).select("doc_id", "p.*")


@query()
def numberings(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", segment.numbering_column(F.col("t")).alias("n")).where("n is not null").select("doc_id", "line", "n.*")


@query("select doc_id, line, length(t)::int as n from (select doc_id, generate_subscripts(x, 1) - 1 as line, trim(unnest(x), chr(13)) as t from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null)) where regexp_full_match(t, '\\*{3,}|\\+{3,}|-{3,}|={3,}|_{3,}|~{3,}')")
def rule_lines(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    t = F.regexp_replace("t", "^\r+|\r+$", "")
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.length(t).alias("n"), t.alias("t")).where(F.col("t").rlike(r"^([*+=_~-])\1{2,}$")).drop("t")


def _segments(s: SparkSession, d: str) -> DataFrame:
    flags = ["has_blank_line_before", "has_delim_line_before", "has_newline"]
    t = table(s, d, "segments").where("doc_id is not null and seg_idx is not null")
    return t.groupBy("doc_id", "seg_idx").agg(F.max(F.struct("loaded_at", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags], F.col("hdr_level").alias("level"), "title_offset", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))).alias("m")).select("doc_id", "seg_idx", "m.*").drop("loaded_at")


ONE_SEGMENT = """(select doc_id, seg_idx, m.* from (select doc_id, seg_idx, arg_max(struct_pack(blank := coalesce(has_blank_line_before, false), rule := coalesce(has_delim_line_before, false), newline := coalesce(has_newline, false),
  "level" := hdr_level, title_offset := title_offset, "start" := seg_start, "end" := seg_end), loaded_at) as m from segments where doc_id is not null and seg_idx is not null group by 1, 2))"""


@query(
    f"""select doc_id, seg_idx, case when alone then "level" end as level, case when alone then title_offset end as title_offset from (
  select *, (lag(seg_idx) over w is null or blank or rule) and not newline and (lead(seg_idx) over w is null or lead(blank) over w or lead(rule) over w) as alone from {ONE_SEGMENT} window w as (partition by doc_id order by seg_idx))"""
)
def segment_headers(s: SparkSession, d: str) -> DataFrame:
    t = _segments(s, d)
    return segment.with_headers(t, t.select("doc_id", "seg_idx", "level", "title_offset")).select("doc_id", "seg_idx", "level", "title_offset")


@query(
    f"""with x as (select *, last_value(case when "level" is not null then seg_idx end ignore nulls) over (partition by doc_id order by seg_idx rows between unbounded preceding and 1 preceding) as prev,
  "level" is null and (blank or coalesce(lag("level") over w is not null, false) or lag(seg_idx) over w is null) as opens from {ONE_SEGMENT} window w as (partition by doc_id order by seg_idx))
select doc_id, seg_idx, case when "level" is null then prev else (select max(h.seg_idx) from x h where h.doc_id = x.doc_id and h."level" < x."level" and h.seg_idx < x.seg_idx) end as owner,
  case when "level" is null then sum(opens::int) over (partition by doc_id order by seg_idx) end::bigint as paragraph from x"""
)
def segment_owners(s: SparkSession, d: str) -> DataFrame:
    return sections.section_nodes_of(_segments(s, d))


@query()
def section_tree(s: SparkSession, d: str) -> DataFrame:
    return sections.section_nodes(table(s, d, "documents"))


@query()
def section_children(s: SparkSession, d: str) -> DataFrame:
    return sections.children(sections.section_nodes(table(s, d, "documents")))


@query()
def content_sections(s: SparkSession, d: str) -> DataFrame:
    got = sections.content_sections(sections.section_nodes(table(s, d, "documents")))
    return got.withColumn("ancestors", _text(F.col("ancestors")))


@query()
def section_outline(s: SparkSession, d: str) -> DataFrame:
    return sections.outline(sections.section_nodes(table(s, d, "documents")))


@query()
def section_contents(s: SparkSession, d: str) -> DataFrame:
    """Each section's header, its own or inherited, and the text of its content."""
    t = table(s, d, "documents").select("doc_id", "text")
    got = sections.contents(sections.section_nodes(t)).join(t, "doc_id")
    return got.select("doc_id", "node_id", "header_id", "level", "start", "end", R.extract(F.col("text"), F.struct("start", "end")).alias("content"))


@query()
def direct_content(s: SparkSession, d: str) -> DataFrame:
    return sections.direct_content(sections.section_nodes(table(s, d, "documents")))


@query()
def outlines(s: SparkSession, d: str) -> DataFrame:
    return sections.outlines(sections.section_nodes(table(s, d, "documents")))


@query()
def paragraphs(s: SparkSession, d: str) -> DataFrame:
    return sections.paragraphs(sections.section_nodes(table(s, d, "documents")))


@query()
def header_titles(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("doc_id", "text")
    h = segment.segments(t, headers=True).where("level is not null")
    return h.join(t, "doc_id").select("doc_id", "seg_idx", "level", R.title(F.col("text"), F.struct("start", "end"), F.col("title_offset")).alias("title"), R.to_string(F.struct("start", "end"), "Header").alias("name"))


# ---- ranges

RANGE = "greatest(coalesce(\"start\", 0), 0)"
CLAMPED = f"(select doc_id, seg_idx, {RANGE} as s, case when \"end\" > 0 then \"end\" else {RANGE} end as e from {ONE_SEGMENT})"


def _clamped(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).select("doc_id", "seg_idx", R.clamp(F.col("start"), F.col("end")).alias("a"))


@query(f"select doc_id, seg_idx, s, e, e - s as span, '[' || s || ',' || e || ']' as json, 'Segment [' || s || ', ' || e || ']' as name from {CLAMPED}")
def segment_ranges(s: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _clamped(s, d).select("doc_id", "seg_idx", a["start"].alias("s"), a["end"].alias("e"), R.span(a).alias("span"), R.to_json(a).alias("json"), R.to_string(a).alias("name"))


@query(f"select c.doc_id, seg_idx, substr(text, s + 1, e - s) as part from {CLAMPED} c join documents t on t.doc_id = c.doc_id where s <= e and text is not null")
def segment_texts(s: SparkSession, d: str) -> DataFrame:
    got = _clamped(s, d).join(table(s, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id").where("a.start <= a.end")
    return got.select("doc_id", "seg_idx", R.extract(F.col("text"), F.col("a")).alias("part"))


@query(
    f"""select doc_id, seg_idx, case when b is not null and greatest(s, b) < least(e, z) then greatest(s, b) end as both_start, case when b is not null and greatest(s, b) < least(e, z) then least(e, z) end as both_end,
  greatest(s, b) < least(e, z) and b is not null as meet, s <= b and e >= z as holds from (select *, lead(s) over w as b, lead(e) over w as z from {CLAMPED} window w as (partition by doc_id order by seg_idx)) where b is not null"""
)
def neighbour_ranges(s: SparkSession, d: str) -> DataFrame:
    got = _clamped(s, d).withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("seg_idx"))).where("b is not null")
    a, b = F.col("a"), F.col("b")
    both = R.overlap(a, b)
    return got.select("doc_id", "seg_idx", both["start"].alias("both_start"), both["end"].alias("both_end"), R.overlaps(a, b).alias("meet"), R.contains(a, b).alias("holds"))


@query(f"select a.doc_id, a.s as a_start, a.e as a_end, b.s as b_start, b.e as b_end from {CLAMPED} a join {CLAMPED} b on a.doc_id = b.doc_id and greatest(a.s, b.s) < least(a.e, b.e) where a.s < a.e and b.s < b.e")
def overlapping_segments(s: SparkSession, d: str) -> DataFrame:
    t = _clamped(s, d).select("doc_id", F.col("a.start").alias("start"), F.col("a.end").alias("end"))
    return R.overlapping(t, t, "doc_id")


@query(f"select doc_id, seg_idx, s as start, case when e = 0 then s else e end as end from (select doc_id, seg_idx, \"start\" as s, coalesce(\"end\", \"start\") as e from {ONE_SEGMENT})")
def range_bounds(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).select("doc_id", "seg_idx", R.bounds(F.col("start"), F.col("end")).alias("b")).select("doc_id", "seg_idx", "b.*")


# ---- sources, streams, functions in SQL


def _streamed(s: SparkSession, d: str, text: Column) -> DataFrame:
    """Rows (type, value, freq) from a stream that reads the documents file by file; text is what counts of each."""
    schema = table(s, d, "documents").schema
    import os

    path = f"{d}/documents.parquet"
    stream = s.readStream.schema(schema).parquet(path) if os.path.isdir(path) else s.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(d)
    folder = f"{shared_folder(s)}/words-{uuid.uuid4().hex}"
    streaming.start(stream.select("doc_id", text.alias("text")), folder).awaitTermination()
    return streaming.latest(s, folder)


@query(f"select lower(w) as value, count(*) as freq from (select unnest(regexp_extract_all({LETTERS}, '[A-Za-z]+')) as w from documents) group by 1")
def streamed_words(s: SparkSession, d: str) -> DataFrame:
    """Frequencies of words from a stream of the letters only, as far as SQL can count them."""
    return _streamed(s, d, F.regexp_replace("text", "[^A-Za-z ]+", " ")).where("type = 0").select("value", "freq")


@query()
def streamed_tokens(s: SparkSession, d: str) -> DataFrame:
    """Frequencies of words and delimiters from a stream of the texts as they are."""
    return _streamed(s, d, F.col("text")).select("type", "value", "freq")


@query(
    f"""select rec_id, array_to_string(list_sort(list_intersect(a, b)), ',') as both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as either,
  array_to_string(list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: list_contains(a, x) <> list_contains(b, x))), ',') as one,
  case when len(list_distinct(list_concat(a, b))) = 0 then 'NaN'::double else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end as jaccard from {ONE_SIGNATURE}"""
)
def sql_functions(s: SparkSession, d: str) -> DataFrame:
    register(s)
    text = lambda f, name: F.array_join(F.expr(f"cast({f}(a, b) as array<string>)"), ",").alias(name)
    return _sets(s, d).select("rec_id", text("gm_and", "both"), text("gm_or", "either"), text("gm_xor", "one"), F.expr("gm_jaccard(a, b)").alias("jaccard"))


@query("select doc_id, strlen(text) as bytes, text as again, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents where text is not null")
def sql_strings(s: SparkSession, d: str) -> DataFrame:
    register(s)
    t = table(s, d, "documents").where("text is not null")
    return t.selectExpr("doc_id", "cast(length(gm_byte_string(text)) as bigint) as bytes", "gm_from_byte_string(gm_byte_string(text)) as again", "gm_ascii_lower(text) as low")


@query()
def sql_tables(s: SparkSession, d: str) -> DataFrame:
    """Tokens and segments of all texts by the table functions."""
    register(s)
    table(s, d, "documents").select("doc_id", "text").createOrReplaceTempView("gm_texts")
    tokens = s.sql("select doc_id, 'token' as what, pos, value from gm_texts, lateral gm_token_rows(text)")
    return tokens.union(s.sql("select doc_id, 'segment', seg_idx, concat(start, ',', `end`) from gm_texts, lateral gm_segment_rows(text)"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
