"""How far the word use of a source lies from its language and from the other sources of that language.

Words are counted by Arrow kernels inside mapInArrow: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and
hash ``group_by``, first per (document, term), then per (group, term). A task merges what its batches hold and hands out
partial counts; Spark adds them up. A language keeps the terms that occur in at least ``least_docs`` of its documents. With N
occurrences of V kept terms, a group gives a term that occurs n times the share p = 1 + floor(10^9 (n + 5) / (N + 5 V)), all in
whole numbers.

The terms of a language are dealt to shards by hash, so that one shard holds a table of about CELLS (source, term)
shares; a shard adds up the differences of its terms for every pair of sources, and the sums of the shards are added. So a
language or source with a third of all rows is spread, and no task sees a whole vocabulary. All pairs of sources of a language
are the result itself; documents never meet.

Defined cases: null text, language or source is the empty string; a text without terms still makes its group occur; repeated
rows count each; equal values rank by the bytes of the item; very long texts are taken whole; an empty table gives no rows;
other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CELLS = 100_000  # shares that one shard holds at a time, or as many as pairs of sources up to 4,000,000
HELD = 400_000  # partial counts that a task holds before it merges or hands them out
KEYS = ["lang", "source", "term"]


def count_terms(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """lang, source, term, n (occurrences), docs (documents) of one batch; the term '' marks a group that occurs."""
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    width = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + sources.indices.to_numpy(zero_copy_only=False)
    split = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN_TERMS)
    term, doc = pc.list_flatten(split), pc.list_parent_indices(split)
    there = pc.not_equal(term, "")
    term, doc = term.filter(there).dictionary_encode(), doc.filter(there)
    in_docs = pa.table({"doc": doc, "term": term.indices}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    in_groups = pa.table({"group": pa.array(group).take(in_docs["doc"]), "term": in_docs["term"], "n": in_docs["count_all"]})
    in_groups = in_groups.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    found = np.unique(group)
    groups = np.concatenate([in_groups["group"].to_numpy(), found])
    zeros = pa.array(np.zeros(len(found), np.int64))
    terms = term.dictionary.take(in_groups["term"].combine_chunks().cast(pa.int64()))
    return pa.table({
        "lang": langs.dictionary.take(pa.array(groups // width)), "source": sources.dictionary.take(pa.array(groups % width)),
        "term": pa.concat_arrays([*(terms.chunks if isinstance(terms, pa.ChunkedArray) else [terms]), pa.array([""] * len(found), terms.type)]),
        "n": pa.chunked_array([*in_groups["n_sum"].cast(pa.int64()).chunks, zeros]), "docs": pa.chunked_array([*in_groups["n_count"].cast(pa.int64()).chunks, zeros]),
    })


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of each task."""

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*KEYS, "n", "docs"])

        def handed(table: pa.Table) -> Iterator[dict]:
            for batch in table.to_batches(max_chunksize=50_000):
                yield {c: batch.column(c) for c in batch.schema.names}

        for part in parts:
            columns = [pc.fill_null(part[c], "").cast(pa.string()) for c in ("text", "lang", "source")]
            if not len(columns[0]):
                continue
            held.append(count_terms(*columns))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from handed(held.pop())
        if held:
            yield from handed(merged())

    columns = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return map_texts(columns, ["text", "lang", "source"], work, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str) -> str:
    """SQL of the share of a term with n occurrences among total = N and V kept terms."""
    return f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(20,0))) div cast({total} + 5 * v as decimal(20,0))"


def kept_terms(docs: DataFrame, scratch: Scratch, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(groups, terms): groups has lang, source, total, lang_total, v, sources; terms has lang, source, term, n, lang_n."""
    counts = partial_counts(docs).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.stage(counts, "counts")
    of_term = Window.partitionBy("lang", "term")
    terms = counts.where("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("df"), F.sum("n").over(of_term).alias("lang_n"),
                                              F.row_number().over(of_term.orderBy("source")).alias("k"))
    terms = scratch.stage(terms.where(F.col("df") >= least_docs).drop("df"), "terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("k") == 1).alias("first"))
    of_lang = Window.partitionBy("lang")
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("total").over(of_lang), F.lit(0)).alias("lang_total"),
                           F.coalesce(F.sum("first").over(of_lang), F.lit(0)).alias("v"), F.count("*").over(of_lang).alias("sources"))
    groups = scratch.stage(groups, "groups")
    scratch.drop(counts)
    return groups, terms.drop("k")


def shards() -> str:
    """SQL of the number of shards of a language; a shard hands out a sum for each pair of sources, so it holds no fewer shares."""
    return f"cast(greatest(1, ceil(v * sources / greatest({CELLS}, least(sources * sources, 4000000)))) as int)"


def shard_sums(key: tuple, shares: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, source, item, value: the differences of one shard's terms, added up per pair of sources."""
    sources = groups.column("source").to_pylist()
    order = sorted(range(len(sources)), key=lambda k: sources[k])
    place = {sources[k]: at for at, k in enumerate(order)}
    base = groups.column("base").to_numpy()[order]
    term = shares.column("term").combine_chunks().dictionary_encode()
    table = np.repeat(base[:, None], len(term.dictionary), axis=1)
    table[[place[s] for s in shares.column("source").to_pylist()], term.indices.to_numpy(zero_copy_only=False)] = shares.column("p").to_numpy()
    sums = [np.abs(table[k + 1 :] - table[k]).sum(axis=1) for k in range(len(order))]
    first, second = np.triu_indices(len(order), 1)
    names = pa.array([sources[k] for k in order], pa.string())
    lang = pa.array([groups.column("lang")[0].as_py()] * len(first), pa.string())
    value = pa.array(np.concatenate([np.zeros(0, np.int64), *sums]), pa.int64())
    return pa.table({"lang": lang, "source": names.take(pa.array(first)), "item": names.take(pa.array(second)), "value": value})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: 'pair' rows hold the distance to every other source of the language, 'term' rows
    the terms that the source uses more than its language, the ``top`` largest differences."""
    scratch = Scratch(docs.sparkSession)
    groups, terms = kept_terms(docs, scratch, least_docs)
    shares = terms.join(groups, ["lang", "source"]).withColumns({
        "p": F.expr(share("n", "total")), "q": F.expr(share("lang_n", "lang_total")), "shards": F.expr(shards())})

    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = more.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top)

    dealt = shares.select("lang", F.expr("cast(pmod(xxhash64(term), shards) as int)").alias("shard"), "source", "term", "p")
    base = groups.select("lang", F.expr(f"explode(sequence(0, {shards()} - 1))").alias("shard"), "source",
                         F.expr(f"if(v = 0, 0L, {share('0', 'total')})").alias("base"))
    sums = dealt.groupBy("lang", "shard").cogroup(base.groupBy("lang", "shard")).applyInArrow(shard_sums, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.expr("inline(array(struct(source, item), struct(item as source, source as item)))"), "value")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_group))
    return pairs.unionByName(more)


SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
groups as (select distinct lang, source from docs),
words as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*)::hugeint as n from words group by all having count(distinct r) >= 30),
used as (select w.lang, w.source, w.term, count(*)::hugeint as n from words w join kept using (lang, term) group by all),
langs as (select lang, sum(n)::hugeint as total, count(*)::hugeint as v from kept group by lang),
cells as (
  select g.lang, g.source, k.term, coalesce(u.n, 0) as n, k.n as lang_n, l.total as lang_total, l.v,
    sum(coalesce(u.n, 0)) over (partition by g.lang, g.source)::hugeint as total
  from groups g join kept k using (lang) join langs l using (lang) left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term),
shares as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as p, 1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * v) as q from cells),
pairs as (
  select g.lang, g.source, 'pair' as part, o.source as item, coalesce(d.value, 0) as value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term
    group by all) d on d.lang = g.lang and d.source = g.source and d.item = o.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""
