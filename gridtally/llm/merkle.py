"""Merkle manifest of a table of documents: leaves, subroots of sources, a root, proofs and their check.

Nodes of one level that belong together are kept as one string of fixed-width hex digests for each
aligned block of width * width nodes. Fixed-width substrings of it are hashed to the parents, and the
substrings beside a node are its siblings. The blocks' own roots are the nodes of the next round, so
the rounds shrink by the block size until each source has one block; the sources' subroots then climb
the same way to the root. No task holds more than a block, however large a source is: places within a
source come from ranges of rows and their counts.

Defined results: a null in a column of the leaf is `-`, an empty text `0:`; a null source is a source
of its own, before all others; null doc_ids come first in their source and are never tampered with;
rows with the same doc_id lie side by side in the order of their leaves, so repeated rows have the
same leaf and proofs of their own places; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import small, stored
from gridtally.llm.ranks import ranked

#: Columns that make a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
_STEPS = "array<struct<l: binary, r: binary>>"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def leaf_of(cells: dict[str, Column]) -> Column:
    """Digest of a row: each value with its length in bytes, `-` for null."""
    parts = []
    for name in LEAF:
        value = cells[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, changed): g orders sources, null first; changed is the leaf of a tampered row, else null."""
    cells = {c: F.col(f"`{c}`") for c in LEAF}
    tampered = F.crc32(cells["doc_id"].cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered & cells["text"].isNotNull(), leaf_of({**cells, "text": ascii_lower(cells["text"].cast("string"))}))
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), cells["source"].cast("string")), F.lit("0")).alias("g"),
        cells["doc_id"].alias("doc_id"), F.unhex(leaf_of(cells)).alias("leaf"), F.unhex(changed).alias("changed"))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def blocked(nodes: DataFrame, width: int) -> DataFrame:
    """Blocks of nodes (g, pos, n, leaf and others): members in order, two levels as strings, the block's root.

    `rounds` is how many levels are hashed in this block: both where the source goes on above it,
    fewer where one node is left earlier.
    """
    size = width * width
    rest = [c for c in nodes.columns if c not in ("g", "pos", "n")]
    rows = nodes.groupBy("g", F.expr(f"pos div {size}").alias("b")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("members"))
    n = F.col("n")
    rounds = F.when(n == 1, 0).when(n <= width, 1).otherwise(2)
    low = F.array_join(F.transform("members", lambda m: _hex(m["leaf"])), "").cast("binary")
    rows = rows.select("*", rounds.alias("rounds"), low.alias("l0"))
    run = width * HEX
    parents = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("members") / width).cast("int") - 1),
        lambda i: F.sha2(F.substr(F.col("l0"), i * run + 1, F.lit(run)), 256))
    rows = rows.withColumn("l1", F.when(F.col("rounds") == 2, F.array_join(parents, "").cast("binary")))
    top = F.when(F.col("rounds") == 0, F.col("l0").cast("string")).otherwise(F.sha2(F.coalesce("l1", "l0"), 256))
    return rows.withColumn("top", top)


def climbed(nodes: DataFrame, width: int) -> list[DataFrame]:
    """Stored blocks of every round; the last round has one block for each group that is left."""
    size = width * width
    tables = []
    while True:
        table = stored(blocked(nodes, width), "merkle-blocks")
        tables.append(table)
        more = table.where(F.col("n") > size)
        if more.isEmpty():
            return tables
        nodes = more.select("g", F.col("b").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.unhex("top").alias("leaf"))


def roots_of(tables: list[DataFrame], width: int) -> DataFrame:
    """(g, root): each group ends in the round where it has one block."""
    ends = [t.where(F.col("n") <= width * width).select("g", F.col("top").alias("root")) for t in tables]
    found = ends[0]
    for end in ends[1:]:
        found = found.unionAll(end)
    return found


def _steps(width: int) -> Column:
    """The siblings left and right of a member of a block, level by level; `slot` is its place there."""
    slot, run = F.col("slot"), width * HEX
    high = F.expr(f"slot div {width}").cast("int")
    inner = F.col("slot") % width
    own = F.struct(
        F.substr(F.col("l0"), high * run + 1, inner * HEX).alias("l"),
        F.substr(F.col("l0"), (slot + 1) * HEX + 1, (width - 1 - inner) * HEX).alias("r"))
    above = F.struct(
        F.substr(F.col("l1"), F.lit(1), high * HEX).alias("l"), F.substr(F.col("l1"), (high + 1) * HEX + 1, F.lit(run)).alias("r"))
    return (F.when(F.col("rounds") == 0, F.array().cast(_STEPS))
            .when(F.col("rounds") == 1, F.array(own).cast(_STEPS)).otherwise(F.array(own, above).cast(_STEPS)))


def _members(table: DataFrame, paths: DataFrame | None, width: int, keep: list[str]) -> DataFrame:
    """Members of the blocks with the siblings on their way to the group's root."""
    rows = table.drop("top", "n")
    empty = F.array().cast(_STEPS)
    if paths is None:
        rows = rows.withColumn("path", empty)
    else:
        # A path has about four kilobytes: broadcast only up to some megabytes.
        above = small(paths.select("g", F.col("pos").alias("b"), F.col("steps").alias("path")), rows=2_000)
        rows = rows.join(above, ["g", "b"], "left").withColumn("path", F.coalesce("path", empty))
    rows = rows.select("g", "rounds", "l0", "l1", "path", F.posexplode("members").alias("slot", "m"))
    return rows.select("g", F.col("m.pos").alias("pos"), *[F.col(f"m.{c}").alias(c) for c in keep], F.concat(_steps(width), F.col("path")).alias("steps"))


def with_paths(tables: list[DataFrame], width: int, keep: list[str]) -> DataFrame:
    """(g, pos, kept columns, steps) of the nodes that the climb began with."""
    paths = None
    for table in reversed(tables[1:]):
        paths = _members(table, paths, width, [])
    return _members(tables[0], paths, width, keep)


@dataclass
class Manifest:
    """Stored trees of a table: one of each source's leaves, one of the sources' subroots."""

    width: int
    sources: list[DataFrame]
    tops: list[DataFrame]

    def subroots(self) -> DataFrame:
        """(g, subroot) of every source; g is the source after a `1`, or `0` for null."""
        return roots_of(self.sources, self.width).withColumnRenamed("root", "subroot")

    def root(self) -> str | None:
        """The root of all, null for an empty table: one row."""
        found = roots_of(self.tops, self.width).first()
        return found and found["root"]


def manifest(docs: DataFrame, width: int = 16) -> Manifest:
    """The trees over docs: leaves ascend by doc_id in each source, sources by their bytes."""
    rows = stored(leaves(docs), "merkle-leaves")
    sources = climbed(ranked(rows, ["g"], ["doc_id", "leaf"], "merkle-ranked"), width)
    tops = roots_of(sources, width).select(F.lit("").alias("all"), F.col("g").alias("name"), F.unhex("root").alias("leaf"))
    placed = ranked(tops, ["all"], ["name"], "merkle-sources").withColumnRenamed("all", "g")
    return Manifest(width, sources, climbed(placed, width))


def proofs(made: Manifest) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, steps) of every row: steps are the siblings to the root, left and right."""
    rows = with_paths(made.sources, made.width, ["doc_id", "leaf", "changed"])
    upper = with_paths(made.tops, made.width, ["name"]).select(F.col("name").alias("g"), F.col("steps").alias("over"))
    tops = small(made.subroots().join(upper, "g"), rows=2_000)
    rows = rows.join(tops, "g")
    return rows.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("changed")).alias("changed"), "subroot",
                       F.lit(made.root()).cast("string").alias("root"), F.concat("steps", "over").alias("steps"))


def proof_text(steps: Column) -> Column:
    """The siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"]).cast("string")), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["l"], node.cast("binary"), s["r"]), 256))


def digest(docs: DataFrame, width: int = 16) -> DataFrame:
    """Per row: its leaf, roots, the digest of its proof, and whether the row as found leads to the root."""
    rows = proofs(manifest(docs, width))
    found = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
