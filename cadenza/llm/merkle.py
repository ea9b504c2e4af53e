"""A Merkle manifest of a dataset: a hash tree per language, a tree over their roots, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs one after another. A leaf is H of the row's fields, each ``-`` if null, else its
UTF-8 byte count, ``:`` and the value. Within a tree leaves have ranks; every ``arity`` consecutive nodes of a level, and what
is left of them at the end, become their H, until one node remains.

Trees are nested intervals. A node is labelled with the interval [lo, hi) of leaf ranks that it covers, so node k of level l
starts at k * arity^l. A node's ancestor at level l is the interval of that level which contains it; as intervals of one level
do not overlap, containment is a join on the bucket ``lo div arity^l`` of that level plus a check of the bounds. The siblings on
the path are what is left of the parent's interval when the child's is taken out: the children of that parent that lie before
and after it.

Levels come in bands of ``levels``. A band is built in groups of at most arity^levels nodes; the top nodes of a band are the leaves of
the next, so a tree of n leaves takes log(n) / levels rounds whose tables shrink by arity^levels, and a leaf joins only the
ancestors of its own band: those above are joined once per top node and handed down. No group grows with the data, and a
language with a third of all rows is only a longer tree. Ranks come from a range partitioning by (tree, order, row number), so
rows of one language or one value are spread over tasks too.

Defined cases: null language is its own tree, first in order; leaves ascend by doc_id (null first), rows of one doc_id by leaf,
equal rows by number; a lone leaf is its tree's root and its proof is empty; very long texts are hashed whole; an
empty table gives no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ARITY = 2
BAND = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def ranked(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """leaves (tree, row, ...; written) with rank, the place in its tree by the columns of order, and size, the tree's leaves."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "part", "place"])
            at += n

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order, "row"]]
    placed = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, f"{kinds}, part int, place long")
    placed = scratch.stage(placed, "placed")
    parts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                          F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return placed.join(starts, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def height(size: int, arity: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


def grow(units: DataFrame, band: int, arity: int, levels: int) -> DataFrame:
    """tree, level, lo, hi, hash, top: all nodes of one band over its leaves units (tree, lo, hi, hash, size).

    top marks the last level of the band: the leaves of the next band, or the root."""
    from hashlib import sha256

    wide = arity**band

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("lo")
        left = -(-group.column("size")[0].as_py() // wide)  # nodes of the whole tree on the level below
        los, his, hashes = (group.column(c).to_pylist() for c in ("lo", "hi", "hash"))
        out = {c: [] for c in ("level", "lo", "hi", "hash")}
        level = band
        while left > 1 and level < band + levels:
            left, level = -(-left // arity), level + 1
            los, his = los[::arity], [his[min(k + arity, len(his)) - 1] for k in range(0, len(his), arity)]
            hashes = [sha256("".join(hashes[k : k + arity]).encode()).hexdigest() for k in range(0, len(hashes), arity)]
            for c, values in (("level", [level] * len(los)), ("lo", los), ("hi", his), ("hash", hashes)):
                out[c] += values
        top = pa.array([x == level for x in out["level"]], pa.bool_())
        return pa.table({"tree": pa.array([key[0].as_py()] * len(top), pa.string()), "level": pa.array(out["level"], pa.int32()), "lo": pa.array(out["lo"], pa.int64()),
                         "hi": pa.array(out["hi"], pa.int64()), "hash": pa.array(out["hash"], pa.string()), "top": top})

    block = F.expr(f"lo div {wide * arity**levels}L").alias("block")
    return units.select("tree", block, "lo", "hi", "hash", "size").groupBy("tree", "block").applyInArrow(build, "tree string, level int, lo long, hi long, hash string, top boolean")


def paths_in_band(units: DataFrame, nodes: DataFrame, band: int, arity: int, levels: int) -> DataFrame:
    """tree, lo, path for units below nodes of their band: path holds (level, before, after) upwards, the hashes of the siblings
    before and after one another."""
    widths = ", ".join(f"{arity ** k}L" for k in range(band, band + levels + 1))
    width = lambda level: f"element_at(array({widths}), {level} - {band - 1})"
    below = units.select("tree", F.lit(band).alias("level"), "lo", "hi", "hash").unionByName(nodes.where("not top or level < " + str(band + levels)).select("tree", "level", "lo", "hi", "hash"))
    children = below.groupBy("tree", (F.col("level") + 1).alias("level"), F.expr(f"lo div {width('(level + 1)')}").alias("bucket"))
    parents = children.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("children"))
    parents = parents.select("*", F.expr("children[0].lo").alias("from"), F.expr("children[size(children) - 1].hi").alias("to"))
    tops = " + ".join(f"int(size > {arity ** k}L)" for k in range(band, band + levels))  # levels of the tree in this band
    inside = units.where(f"size > {arity**band}L").select("tree", "lo", "hi", F.expr(f"explode(sequence({band} + 1, {band} + {tops}))").alias("level"))
    inside = inside.withColumn("bucket", F.expr(f"lo div {width('level')}"))
    found = inside.join(parents, ["tree", "level", "bucket"]).where("from <= lo and hi <= to")
    side = lambda test: F.expr(f"array_join(transform(filter(children, c -> {test}), c -> c.hash), '')")
    found = found.select("tree", "lo", "level", side("c.hi <= lo").alias("before"), side("c.lo >= hi").alias("after"))
    return found.groupBy("tree", "lo").agg(F.sort_array(F.collect_list(F.struct("level", "before", "after"))).alias("path"))


def prove(leaves: DataFrame, scratch: Scratch, arity: int = ARITY, levels: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(leaves with path, roots): leaves (tree, rank, size, hash, ...; written) with the siblings up to their tree's root, and
    the roots as (tree, hash)."""
    bands: list[tuple[DataFrame, DataFrame]] = []
    units = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "hash", "size")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    rounds = -(-height(largest, arity) // levels)
    roots = units.where("size = 1").select("tree", "hash")
    for k in range(rounds):
        nodes = scratch.stage(grow(units.where(f"size > {arity ** (k * levels)}L"), k * levels, arity, levels), "nodes")
        bands.append((units, nodes))
        tops = nodes.where("top").join(leaves.where("rank = 0").select("tree", "size"), "tree")
        roots = roots.unionByName(tops.where("lo = 0 and hi = size").select("tree", "hash"))
        units = tops.select("tree", "lo", "hi", "hash", "size")
    above = None
    for k in reversed(range(rounds)):
        units, nodes = bands[k]
        own = paths_in_band(units, nodes, k * levels, arity, levels)
        if above is not None:
            block = F.expr(f"lo div {arity ** ((k + 1) * levels)}L * {arity ** ((k + 1) * levels)}L")
            higher = above.select("tree", F.col("lo").alias("top_lo"), F.col("path").alias("rest"))
            own = own.withColumn("top_lo", block).join(higher, ["tree", "top_lo"], "left")
            own = own.select("tree", "lo", F.concat("path", F.coalesce("rest", F.expr("array()"))).alias("path"))
        above = scratch.stage(own, "paths") if k else own
    if above is None:
        return leaves.withColumn("path", F.expr("cast(array() as array<struct<level: int, before: string, after: string>>)")), roots
    joined = leaves.join(above.withColumnRenamed("lo", "rank"), ["tree", "rank"], "left")
    return joined.withColumn("path", F.coalesce("path", F.expr("array()"))), roots


def fold(leaf: str, path: str) -> str:
    """SQL of the root that a leaf and its siblings give."""
    return f"aggregate({path}, {leaf}, (h, s) -> sha2(concat(s.before, h, s.after), 256))"


def manifest(docs: DataFrame, scratch: Scratch, tampered: Column, arity: int = ARITY, levels: int = BAND) -> DataFrame:
    """row, doc_id, leaf, other (the leaf after tampering, null where none), subroot, root and path of every row, written."""
    row = F.monotonically_increasing_id().alias("row")
    changed = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree")  # null first, else by bytes
    leaves = docs.select(*FIELDS).select(row, tree, "doc_id", leaf_hash([F.col(c) for c in FIELDS]).alias("hash"), F.when(tampered, leaf_hash(changed)).alias("other"))
    leaves = scratch.stage(ranked(scratch.stage(leaves, "leaves"), ["doc_id", "hash"], scratch), "ranked")
    proven, roots = prove(leaves, scratch, arity, levels)
    subroots = scratch.stage(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.lit(0).alias("row"), "hash"), "subroots")
    subroots = scratch.stage(ranked(subroots, ["lang"], scratch), "ranked-subroots")
    tops, root = prove(subroots, scratch, arity, levels)
    tops = tops.select(F.col("lang").alias("tree"), F.col("hash").alias("subroot"), F.col("path").alias("rest"))
    top = root.select("hash").first()  # one row, or none of an empty table
    root = F.lit(top[0] if top else None).cast("string").alias("root")
    return proven.join(tops, "tree").select("row", "doc_id", F.col("hash").alias("leaf"), "other", "subroot", root, F.concat("path", "rest").alias("path"))


def proofs(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, levels: int = BAND) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each of docs.

    Rows that ``tampered`` selects are checked with n_chars one larger: their folded_root is not the root."""
    tampered = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 0") if tampered is None else tampered
    scratch = Scratch(docs.sparkSession)
    out = manifest(docs, scratch, tampered, arity, levels)
    digest = F.sha2(F.expr("array_join(transform(path, s -> concat(s.before, s.after)), '')"), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"), F.expr(fold("coalesce(other, leaf)", "path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_CHANGED = " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)

SQL = f"""
with recursive leaves as (
  select *, coalesce('+' || lang, '') as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank
  from (select doc_id, lang, sha256({_LEAF}) as leaf, sha256({_CHANGED}) as changed,
    list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda a, b: list_reduce([xor(a, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc
    from documents)),
nodes as (
  select tree, 0 as level, rank as k, leaf as h, count(*) over (partition by tree) as n from leaves
  union all
  select tree, level + 1, k // 2, sha256(string_agg(h, '' order by k)), any_value(n + 1) // 2 from nodes where n > 1 group by tree, level, k // 2),
subroots as (select tree, h from nodes where n = 1),
tops as (
  select 0 as level, row_number() over (order by encode(tree)) - 1 as k, h, count(*) over () as n from subroots
  union all
  select level + 1, k // 2, sha256(string_agg(h, '' order by k)), any_value(n + 1) // 2 from tops where n > 1 group by level, k // 2),
every as (
  select tree, level, k, h, n from nodes union all select null, level, k, h, n from tops),
start as (
  select row_number() over () as id, l.*, s.h as subroot, (select h from tops where n = 1) as root,
    case when xor(crc, 4294967295) % 7 = 0 then changed else leaf end as other
  from leaves l join subroots s using (tree)),
places as (select tree, h, row_number() over (order by encode(tree)) - 1 as place from subroots),
climb as (
  select id, tree, 0 as level, rank as k, other as h, '' as proof, false as up, false as done from start
  union all
  select c.id, c.tree,
    case when e.n = 1 and not c.up then 0 else c.level + 1 end,
    case when e.n = 1 and not c.up then p.place else c.k // 2 end,
    case when e.n = 1 then c.h else sha256(case when s.h is null then c.h when s.k < c.k then s.h || c.h else c.h || s.h end) end,
    c.proof || case when e.n = 1 then '' else coalesce(s.h, '') end,
    c.up or e.n = 1, e.n = 1 and c.up
  from climb c join places p using (tree)
  join every e on e.tree is not distinct from (case when c.up then null else c.tree end) and e.level = c.level and e.k = c.k
  left join every s on s.tree is not distinct from e.tree and s.level = c.level and s.k = xor(c.k, 1) and e.n > 1
  where not c.done)
select s.doc_id, s.leaf, s.subroot, s.root, sha256(c.proof) as proof_sha256, c.h as folded_root, c.h = s.root as verified
from start s join climb c using (id) where c.done
"""
