"""A Merkle manifest of a dataset: a root, and for each row a proof that it belongs to it.

Rows are leaves, in order of a key within groups. Levels are made by windows: nodes are partitioned by group and
parent, and the list of a window's nodes in order is both what the parent is the digest of and what gives each node its
siblings; each parent is kept once for the next level. The groups' tops, in order, form a tree of the same kind above.

A proof is an array of (left, right), the digests on either side in a node's run, from the leaf to the root. Paths are joined from
the top down, each level with the one above, an eighth of its size; no run is longer than the fan-out, so no key is hot.

Defined cases: a null is told from an empty text; rows with a null key come first, rows of one key in the order of
their digests; repeated rows are leaves of their own, equal ones in any order (their digests are equal); null groups are a
group, the first; an empty table has no rows and no root; whatever other columns a table has is carried
along and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.llm.common import broadcast_below, crc_mod, stored, table
from foldline.llm.ordering import ordered

NAME = "op11_merkle_manifest"
FAN_OUT = 8
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """SHA-256 of columns: each - if null, else the number of its bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _levels(nodes: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (g, idx, n, node), n being the nodes of the group on this level: tables (g, idx, run, ...) of the levels of
    groups of several nodes, and the groups' tops (g, top)."""
    levels, tops = [], None
    while True:
        alone = nodes.filter("n = 1").select("g", F.col("node").alias("top"))
        tops = alone if tops is None else tops.union(alone)
        many = nodes.filter("n > 1").withColumn("parent", F.expr(f"idx div {fan_out}"))
        w = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = stored(many.withColumn("run", F.collect_list("node").over(w)))
        if level.isEmpty():
            return levels, tops
        levels.append(level)
        parents = level.filter(F.col("idx") % fan_out == 0)  # the first of each run: every parent once
        nodes = parents.select("g", F.col("parent").alias("idx"), F.ceil(F.col("n") / fan_out).alias("n"), F.sha2(F.array_join("run", ""), 256).alias("node"))


def _paths(nodes: DataFrame, levels: list[DataFrame], fan_out: int) -> DataFrame:
    """The nodes of the lowest level with path, the array of (left, right) up to the group's top."""
    up = None
    for level in reversed(levels):
        at = (F.col("idx") % fan_out).cast("int")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(fan_out)), "").alias("right"))
        own = level.withColumn("step", step)
        if up is None:
            up = own.withColumn("path", F.array("step"))
        else:
            above = up.select(F.col("g").alias("_g"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
            up = own.join(above, (F.col("g") == F.col("_g")) & (F.col("parent") == F.col("_idx")), "left").withColumn("path", F.concat(F.array("step"), F.coalesce("_path", F.slice(F.array("step"), 1, 0))))
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    alone = nodes.filter("n = 1").withColumn("path", none)
    columns = [*nodes.columns, "path"]
    return alone.select(columns) if up is None else alone.select(columns).union(up.select(columns))


def manifest(leaves: DataFrame, key: str, group: str, node: str, fan_out: int = FAN_OUT) -> DataFrame:
    """(row, path, subroot, root) of leaves: row holds their columns, path leads over the top of their group to the root."""
    # Groups by code point, null first.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    first = stored(leaves.select(named.alias("g"), F.col(node).alias("node"), F.col(key).alias("k"), F.struct("*").alias("row")))
    numbered = stored(ordered(first, "g", [F.col("k"), F.col("node")]).drop("k").withColumnRenamed("before", "idx"))
    sizes = stored(numbered.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("n")))
    nodes = numbered.join(broadcast_below(sizes), F.col("g") == F.col("_g")).drop("_g")
    levels, tops = _levels(nodes, fan_out)
    paths = _paths(nodes, levels, fan_out)
    # The tree above the groups: its nodes are their tops.
    tops = stored(tops)
    several = stored(ordered(stored(tops.select(F.lit("").alias("g"), F.col("top").alias("node"), F.col("g").alias("of"))), "g", [F.col("of")]).withColumnRenamed("before", "idx").withColumn("n", F.lit(tops.count())))
    upper, roots = _levels(several, fan_out)
    above = _paths(several, upper, fan_out).crossJoin(F.broadcast(roots.select(F.col("top").alias("root"))))  # one row
    above = stored(above.select(F.col("of").alias("_of"), F.col("node").alias("subroot"), F.col("path").alias("_up"), "root"))
    return paths.join(broadcast_below(above), F.col("g") == F.col("_of")).select("row", F.concat("path", "_up").alias("path"), "subroot", "root")


def proof(path: Column) -> Column:
    """SHA-256 of a path's digests, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and a path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, the roots and its proof; where 3 divides crc32(doc_id), the proof is tried with the text in small letters."""
    tampered = F.translate("text", CAPITALS, SMALL)
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    documents = table(spark, sf_dir, "documents")
    leaves = documents.select("doc_id", "lang", digest(*rest, F.col("text")).alias("leaf"), F.when(crc_mod("doc_id", 3) == 0, digest(*rest, tampered)).alias("other"))
    rows = manifest(leaves, "doc_id", "lang", "leaf").select("row.*", "path", "subroot", "root")
    tried = rows.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return tried.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 of the decimal doc_id: each digit, then eight steps of a bit.
_CRC = "list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: case when y >= 0 then xor(x, y) else xor(x >> 1, (x & 1) * 3988292384) end)"


def _tree(name: str, start: str) -> str:
    """Nodes (g, level, idx, n, node), levels upwards from start."""
    return f"""{name} as (
  {start}
  union all
  select g, level + 1, idx // 8, cast(ceil(any_value(n) / 8.0) as bigint), sha256(string_agg(node, '' order by idx)) from {name} where n > 1 group by g, level, idx // 8)"""


SQL = f"""
with recursive leaves as (
  select doc_id, coalesce('=' || lang, '') as g, sha256({_LEAF} || {_field('text')}) as leaf,
    case when coalesce(xor({_CRC}, 4294967295), 0) % 3 = 0 then sha256({_LEAF} || {_field(f"translate(text, '{CAPITALS}', '{SMALL}')")}) end as other from documents),
placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g) as n from leaves),
{_tree("below", "select g, 0 as level, idx, n, leaf as node from placed")},
tops as (select g, node as subroot, row_number() over (order by g) - 1 as idx, count(*) over () as n from below where n = 1),
{_tree("above", "select '' as g, 0 as level, idx, n, subroot as node from tops")},
runs as (
  select g, level, idx // 8 as parent, list(node order by idx) as run from below where n > 1 group by all
  union all
  select '>' || t.g, a.level, a.idx // 8, list(a.node order by a.idx) from above a, tops t where a.n > 1 group by all),
walk as (
  select row_number() over () as id, doc_id, leaf, p.g, p.g as spot, 0 as level, p.idx, coalesce(other, leaf) as node, '' as proof from placed p
  union all
  select w.id, w.doc_id, w.leaf, w.g, case when r.run is null then '>' || w.g else w.spot end,
    case when r.run is null then 0 else w.level + 1 end, case when r.run is null then t.idx else w.idx // 8 end,
    case when r.run is null then w.node else sha256(array_to_string(list_concat(r.run[1:w.idx % 8], [w.node], r.run[w.idx % 8 + 2:]), '')) end,
    case when r.run is null then w.proof else w.proof || array_to_string(list_concat(r.run[1:w.idx % 8], r.run[w.idx % 8 + 2:]), '') end
  from walk w join tops t on t.g = w.g left join runs r on r.g = w.spot and r.level = w.level and r.parent = w.idx // 8
  where r.run is not null or w.spot = w.g),
ends as (select *, row_number() over (partition by id order by spot = g, level desc) as last from walk)
select e.doc_id, e.leaf, t.subroot, (select node from above where n = 1) as root, sha256(e.proof) as proof_sha256, e.node as folded_root, e.node = (select node from above where n = 1) as verified
from ends e join tops t on t.g = e.g where e.last = 1
"""
