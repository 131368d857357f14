"""Merkle manifest of a dataset: every aligned block of nodes keeps its levels as strings of concatenated digests.

Rows are leaves of a tree for each source; the roots of the sources are the leaves of one more tree. A
block holds ``BLOCK`` = 3 ** LEVELS consecutive nodes: its lowest level is one string of fixed-width hexadecimal
digests, a parent is the hash of a fixed-width substring of it, and what flanks a node in its run of three are its
siblings. The roots of blocks are the nodes of the next tree of blocks, until one node is left. Proofs
go the other way: a block adds the siblings of its levels to those of its own root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, table
from linklens.llm.op12_sharding import CRC_TABLE, crc32_sql

#: Children of a node, and characters of a digest (fixed values of the contract).
ARITY, WIDTH = 3, 64
#: Levels of a block: its strings stay so short that a substring costs little.
LEVELS = 5
BLOCK = ARITY**LEVELS
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: ``-`` for null, else the bytes' count, a colon and the value."""
    values = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def number_rows(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with idx and total (place and number of rows in the ``group``) and rank (place of the group).

    Rows are sorted over range partitions, so a group of any size is spread, and places are those in the
    partition plus the counts of the partitions before: one small row for each partition and group.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    placed = materialise(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                         .withColumn("tag", F.monotonically_increasing_id()).withColumn("part", F.shiftright("tag", 33)),
                         "sorted")
    stretches = placed.groupBy("part", group).agg(F.count("*").alias("n"), F.min("tag").alias("first"))
    same = Window.partitionBy(group)
    before = same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = materialise(stretches.select(
        "part", group, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(same).alias("total"),
        (F.min("part").over(same) == F.col("part")).alias("opens")), "stretches")
    # the groups that begin in a partition come after those that begin in earlier ones: one row a partition
    opened = stretches.filter("opens").groupBy("part").agg(F.count("*").alias("n"))
    opened = opened.select(F.col("part").alias("o_part"), F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("groups"))
    ranks = (stretches.filter("opens").join(opened, F.col("part") == F.col("o_part"))
             .select(F.col(group).alias("r_group"), (F.col("groups") + F.row_number().over(
                 Window.partitionBy("part").orderBy(F.col(group).asc_nulls_first())) - 1).alias("rank")))
    known = stretches.join(ranks, F.col(group).eqNullSafe(F.col("r_group"))).select(
        F.col("part").alias("s_part"), F.col(group).alias("s_group"), "first", "ahead", "total", "rank")
    return (placed.join(known, (F.col("part") == F.col("s_part")) & F.col(group).eqNullSafe(F.col("s_group")))
            .withColumn("idx", F.col("ahead") + F.col("tag") - F.col("first")).drop("tag", "part", "s_part", "s_group", "first", "ahead"))


def substrings(text: Column, width: int) -> Column:
    """``text`` cut into pieces of ``width`` characters; the last may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / width) - 1, F.lit(0)).cast("int")),
                       lambda i: F.substring(text, i * width + 1, F.lit(width)))


def blocks_of(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks of ``nodes`` (grp, idx, node, total, and ``carried`` columns).

    (grp, block, total, members, levels, top): members are the carried columns in
    order, levels the strings below the block's root ``top``. In a tree of
    several blocks each goes through all ``LEVELS``, also one with a single node; in a tree of
    one block levels end with one node.
    """
    member = F.struct("idx", F.col("node").alias("digest"), *carried)
    rows = (nodes.groupBy("grp", F.expr(f"idx div {BLOCK}").alias("block"))
            .agg(F.first("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members")))
    rows = rows.withColumn("s0", F.array_join(F.col("members.digest"), ""))
    for k in range(LEVELS):
        here = F.col(f"s{k}")
        parents = F.array_join(F.transform(substrings(here, ARITY * WIDTH), digest), "")
        rows = rows.withColumn(f"s{k + 1}", F.when((F.col("total") > BLOCK) | (F.length(here) > WIDTH), parents))
    levels = F.array_compact(F.array(*[F.col(f"s{k}") for k in range(LEVELS + 1)]))
    rows = rows.select("grp", "block", "total", "members", levels.alias("all"))
    return rows.select("grp", "block", "total", "members", F.slice("all", 1, F.size("all") - 1).alias("levels"),
                       F.element_at("all", -1).alias("top"))


def siblings(levels: Column, place: Column) -> Column:
    """array<struct<before, after>>: what flanks the node at ``place`` and its ancestors, level by level."""
    spans = F.array(*[F.lit(ARITY**k) for k in range(LEVELS)])

    def flanks(level: Column, k: Column) -> Column:
        at = F.floor(place / F.get(spans, k)).cast("int")
        inner = F.pmod(at, F.lit(ARITY))
        return F.struct(F.substring(level, (at - inner) * WIDTH + 1, inner * WIDTH).alias("before"),
                        F.substring(level, (at + 1) * WIDTH + 1, (ARITY - 1 - inner) * WIDTH).alias("after"))

    return F.transform(levels, flanks)


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` and the siblings on its path give."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


_NO_PATH = "CAST(array() AS array<struct<before: string, after: string>>)"


class Trees:
    """Trees over nodes (grp, idx, node, total), one for each grp, in rounds of blocks; every round is written."""

    def __init__(self, nodes: DataFrame, name: str, carried: list[str]) -> None:
        self.rounds: list[DataFrame] = []
        while True:
            blocks = materialise(blocks_of(nodes, [] if self.rounds else carried), f"{name}-blocks")
            self.rounds.append(blocks)
            rest = blocks.filter(F.col("total") > BLOCK)
            if rest.isEmpty():
                break
            nodes = rest.select("grp", F.col("block").alias("idx"), F.col("top").alias("node"),
                                F.ceil(F.col("total") / BLOCK).cast("bigint").alias("total"))

    def roots(self) -> DataFrame:
        """(grp, node) of every tree."""
        tops = [b.filter(F.col("total") <= BLOCK).select("grp", F.col("top").alias("node")) for b in self.rounds]
        return reduce(DataFrame.unionByName, tops)

    def paths(self, above: DataFrame) -> DataFrame:
        """(member, path) of every node of the trees, ``above`` being (grp, path) of their roots.

        Goes from the last round to the first: a node's path is its own siblings in its block and then the path of
        the block's root. member holds idx, digest and the carried columns.
        """
        tops = None
        for blocks in reversed(self.rounds):
            ends = blocks.filter(F.col("total") <= BLOCK).join(above, "grp")
            if tops is not None:
                inner = blocks.filter(F.col("total") > BLOCK).join(tops, ["grp", "block"])
                ends = ends.unionByName(inner)
            exploded = ends.select("grp", "levels", "path", F.explode(F.transform(
                "members", lambda m, i: F.struct(m.alias("member"), i.alias("i")))).alias("m"))
            rows = exploded.select("grp", "m.member", F.concat(siblings(F.col("levels"), F.col("m.i")), F.col("path")).alias("path"))
            tops = rows.select("grp", F.col("member.idx").alias("block"), "path")
        return rows


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
             altered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, group, idx, leaf, subroot, root, path (array of before, after), folded_root, verified.

    ``altered`` is a leaf digest to fold in place of a row's own (null: its own).
    Trees are by ``group`` (null is a group, the first), leaves by ``order`` (null first),
    then by leaf, so repeated rows stand side by side and which is which makes no
    difference. Null fields are hashed as ``-``, empty texts as ``0:``, texts of any
    length whole. A group of one row is its own subroot, a single group's subroot the
    root. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    own = leaf([F.col(f) for f in fields])
    leaves = docs.select(F.col(group).cast("string").alias("grp_key"), F.col(order).alias("id"), own.alias("node"),
                         (F.lit(None).cast("string") if altered is None else altered).alias("other"))
    numbered = materialise(number_rows(leaves, "grp_key", ["id", "node"]), "leaves")
    inner = Trees(numbered.withColumnRenamed("rank", "grp"), "groups", ["id", "other", "grp_key"])
    subroots = materialise(inner.roots(), "subroots")
    groups = subroots.agg(F.count("*")).first()[0]
    outer = Trees(subroots.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("idx"), "node",
                                  F.lit(groups).cast("bigint").alias("total")), "root", [])
    root = outer.roots().first()
    ends = outer.paths(outer.roots().select("grp", F.expr(_NO_PATH).alias("path"))).select(
        F.col("member.idx").alias("grp"), "path")
    rows = inner.paths(materialise(ends, "group-paths"))
    subs = subroots.select(F.col("grp").alias("t_grp"), F.col("node").alias("subroot"))
    rows = rows.join(subs, F.col("grp") == F.col("t_grp"))
    folded = fold(F.coalesce("member.other", "member.digest"), F.col("path"))
    top = F.lit(root["node"] if root else None).cast("string")
    return (rows.select(F.col("member.id").alias("id"), F.col("member.grp_key").alias("group"), F.col("member.idx").alias("idx"),
                        F.col("member.digest").alias("leaf"), "subroot", top.alias("root"), "path", folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
marked AS (
  SELECT *, {crc32_sql("doc_id::VARCHAR")} % 2 = 0 AS tampered FROM documents, crc_table),
leaves AS (
  SELECT doc_id, source, text, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS m, coalesce(tampered, FALSE) AS tampered,
         {{fields}} || coalesce(octet_length(encode(text)) || ':' || text, '-') AS whole,
         {{fields}} || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-') AS cut
  FROM marked),
inner_tree(source, level, i, h, m) AS (
  SELECT source, 0, i, sha256(whole), m FROM leaves
  UNION ALL
  SELECT source, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + {ARITY - 1}) // {ARITY}
  FROM inner_tree WHERE m > 1 GROUP BY source, level, i // {ARITY}),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM inner_tree WHERE m = 1),
outer_tree(level, i, h, m) AS (
  SELECT 0, i, h, m FROM subroots
  UNION ALL
  SELECT level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + {ARITY - 1}) // {ARITY}
  FROM outer_tree WHERE m > 1 GROUP BY level, i // {ARITY}),
steps AS (
  SELECT l.doc_id, l.source, 0 AS part, t.level,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < l.i // ({ARITY}**t.level)::BIGINT), '') AS before,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > l.i // ({ARITY}**t.level)::BIGINT), '') AS after
  FROM leaves l JOIN inner_tree t ON l.source IS NOT DISTINCT FROM t.source AND t.m > 1
    AND t.i // {ARITY} = l.i // ({ARITY}**(t.level + 1))::BIGINT
  GROUP BY l.doc_id, l.source, t.level, l.i
  UNION ALL
  SELECT l.doc_id, l.source, 1, t.level,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < s.i // ({ARITY}**t.level)::BIGINT), ''),
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > s.i // ({ARITY}**t.level)::BIGINT), '')
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN outer_tree t ON t.m > 1
    AND t.i // {ARITY} = s.i // ({ARITY}**(t.level + 1))::BIGINT
  GROUP BY l.doc_id, l.source, t.level, s.i),
proofs AS (
  SELECT l.doc_id, sha256(CASE WHEN l.tampered THEN l.cut ELSE l.whole END) AS start, sha256(l.whole) AS leaf, l.source,
         coalesce(list(s.before ORDER BY s.part, s.level) FILTER (s.part IS NOT NULL), []) AS befores,
         coalesce(list(s.after ORDER BY s.part, s.level) FILTER (s.part IS NOT NULL), []) AS afters
  FROM leaves l LEFT JOIN steps s ON l.doc_id = s.doc_id GROUP BY ALL),
folds(doc_id, k, h) AS (
  SELECT doc_id, 1, start FROM proofs
  UNION ALL
  SELECT f.doc_id, k + 1, sha256(p.befores[k] || f.h || p.afters[k]) FROM folds f JOIN proofs p ON f.doc_id = p.doc_id
  WHERE k <= len(p.befores))
SELECT p.doc_id, p.leaf, s.h AS subroot, o.h AS root,
       sha256(list_aggregate(list_concat([''], list_transform(p.befores, lambda b, k: b || p.afters[k])), 'string_agg', '')) AS proof_sha256,
       f.h AS folded_root, f.h = o.h AS verified
FROM proofs p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN outer_tree o ON o.m = 1
JOIN folds f ON f.doc_id = p.doc_id AND f.k = len(p.befores) + 1
""".replace("{fields}", " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in FIELDS[:-1]))


@query("op13_merkle", _SQL)
def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = leaf([F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS])
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, cut)
    rows = manifest(docs, altered=tampered)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof).alias("proof_sha256"),
                       "folded_root", "verified")
