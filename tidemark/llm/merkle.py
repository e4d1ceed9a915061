"""A Merkle manifest of a data set: one tree per source, one tree over the sources.

Rows become leaves, numbered within their source in ``doc_id`` order. A level of the trees is one aggregation, the slot
pivot: a node's place gives its parent (place / fanout) and its slot (the remainder), and conditional aggregates
spread the children of a parent over one column per slot. Concatenating the columns gives the text that the parent
hashes; leaving out a child's own column gives that child's siblings. Levels are tables in the shared folder, each
a fanout smaller than the one below, so a lost executor costs no level twice.

Proofs go the other way: from the root down every node hands its children the texts before and after their slot on all
levels above. Only level tables, with unique keys on both sides, are joined on the way.

Numbering sorts ranges of (source, ``doc_id``) that follow the quantiles of the rows, so neither a hot source nor
rows that share a ``doc_id`` fill one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions
from tidemark.operators.joins import is_small
from tidemark.session import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every document whose decimal id has a CRC32 divisible by this is tampered with.
TAMPERED = 5
_ROW_BITS = 33
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """Hex SHA-256 of the fields one after another, each ``-`` if null, else its byte count, ``:`` and its text.

    ``changed`` gives other values for some fields.
    """
    return F.sha2(F.concat(*[_field(changed.get(name, F.col(name))) for name in fields]), 256)


def _order_key(column: str) -> Column:
    """A column as its own sort key; a null sorts first, before every value."""
    return F.col(column).asc_nulls_first()


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``place``, from 0 within each group in the given order, and ``n``, the rows of the group.

    Nulls of ``group`` form a group of their own. Every task sorts one range of the whole order; the position in it
    comes from the row numbers of the sorted partition, and the group's rows in earlier ranges from one count per group
    and range. Rows that tie are numbered in any order.
    """
    spark = rows.sparkSession
    keys = [_order_key(c) for c in (*group, *order)]
    sorted_rows = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    ranged = written(sorted_rows.withColumn("row_id", F.monotonically_increasing_id()), "ranged").withColumns(
        {"range": F.shiftright("row_id", _ROW_BITS), "line": F.col("row_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    )
    # A range holds a contiguous run of every group, so its first line is known from one count.
    runs = ranged.groupBy(*group, "range").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {
            "base": F.coalesce(F.sum("held").over(earlier), F.lit(0)),
            "n": F.sum("held").over(Window.partitionBy(*group)),
        }
    ).select(*[F.col(c).alias(f"run_{c}") for c in (*group, "range")], "first", "base", "n")
    runs = written(runs, "runs")
    runs = F.broadcast(runs) if is_small(runs) else runs
    same = F.col("range") == F.col("run_range")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"run_{c}"))
    place = F.col("base") + F.col("line") - F.col("first")
    return ranged.join(runs, same).select(*rows.columns, place.alias("place"), "n")


def _slot(column: str, slot: int, fanout: int) -> Column:
    return F.max(F.when(F.pmod("place", F.lit(fanout)) == slot, F.col(column)))


def level(nodes: DataFrame, group: Sequence[str], fanout: int, carried: Sequence[str] = ()) -> DataFrame:
    """The parents of ``nodes``, one level of all trees that still have several nodes.

    ``nodes`` has the group, ``place``, ``n`` (nodes of the group on this level) and ``h``. A parent has the same columns
    and, per slot s, ``h_s`` of its child there, null beyond the last child. ``carried`` columns of the children are
    spread over slots likewise.
    """
    spread = [_slot(c, s, fanout).alias(f"{c}_{s}") for c in ("h", *carried) for s in range(fanout)]
    parent = F.floor(F.col("place") / fanout).cast("long").alias("parent")
    pivot = nodes.filter("n > 1").groupBy(*group, "n", parent).agg(*spread)
    return pivot.withColumnRenamed("parent", "place").withColumns(
        {
            "n": F.floor((F.col("n") + fanout - 1) / fanout).cast("long"),
            "h": F.sha2(F.concat_ws("", *[F.col(f"h_{s}") for s in range(fanout)]), 256),
        }
    )


class Forest:
    """All levels of the trees over ``nodes`` (see :func:`level`), lowest first; ``tops`` has ``h`` of every tree."""

    def __init__(self, nodes: DataFrame, group: Sequence[str], fanout: int = FANOUT, carried: Sequence[str] = ()):
        self.group, self.fanout = list(group), fanout
        self.levels: list[DataFrame] = []
        self.tops = nodes.filter("n = 1").select(*group, "h")
        below, kept = nodes, list(carried)
        largest = nodes.agg(F.max("n")).first()[0] or 0
        # As many rounds as the largest tree has levels: the logarithm of its rows to the base of the fanout.
        while largest > 1:
            below, kept, largest = written(level(below, group, fanout, kept), "level"), [], -(-largest // fanout)
            self.levels.append(below)
            self.tops = self.tops.unionByName(below.filter("n = 1").select(*group, "h"))

    def _around(self, slot: int) -> Column:
        """The texts before and after a slot in what its parent hashed."""
        before = [F.col(f"h_{s}") for s in range(slot)]
        after = [F.col(f"h_{s}") for s in range(slot + 1, self.fanout)]
        return F.struct(
            (F.concat_ws("", *before) if before else F.lit("")).alias("before"),
            (F.concat_ws("", *after) if after else F.lit("")).alias("after"),
        )

    def _children(self, parents: DataFrame, carried: Sequence[str], more: Sequence[str]) -> DataFrame:
        """Every child of ``parents`` with its path: its own surroundings, then the parent's path; ``more`` is the parent's."""
        slots = [
            F.struct(
                (F.col("place") * self.fanout + s).alias("place"),
                *[F.col(f"{c}_{s}").alias(c) for c in ("h", *carried)],
                F.concat(F.array(self._around(s)), F.col("path")).alias("path"),
            )
            for s in range(self.fanout)
        ]
        return parents.select(*self.group, *more, F.inline(F.array(*slots))).filter("h is not null")

    def paths(self, above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
        """The children of the lowest level with ``path``: what stands before and after them on every level to the top.

        ``above`` gives every group the path of its top, and may give more columns, which its nodes take over. Groups of a
        single node have no children here.
        """
        if not self.levels:
            raise ValueError("no tree has more than one node")
        more = [c for c in above.columns if c not in (*self.group, "path")]
        down = None
        for at, parents in reversed(list(enumerate(self.levels))):
            # Trees end on different levels.
            with_path = _matched(parents.filter("n = 1"), above, self.group)
            if down is not None:
                inner = _matched(parents.filter("n > 1"), down.drop("h"), [*self.group, "place"])
                with_path = with_path.unionByName(inner)
            down = self._children(with_path, [] if at else carried, more)
            if at:
                down = written(down, "paths")
        return down


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which nulls match; ``right`` has every key once."""
    renamed = right.withColumnsRenamed({c: f"right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"right_{c}"))
    return left.join(renamed, same).drop(*[f"right_{c}" for c in on])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, at: F.sha2(F.concat(at["before"], h, at["after"]), 256))


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    fanout: int = FANOUT,
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``path``, ``proof_sha256``, ``folded_root``, ``verified`` per row.

    ``path`` holds the texts before and after the row's node on every level, through the subroot to the root;
    ``proof_sha256`` hashes them one after another. ``changed`` gives fields as they are found when the proof is checked, of
    the rows ``where`` this is true (default: of none); ``folded_root`` is the root that the leaf of these and the path give.

    Leaves ascend by the first of ``fields`` within their group, a null first, then by their hash; rows that repeat
    every field are leaves of their own with equal hashes. A null group is a tree of its own, before all others; an
    empty one is the next. A null field is hashed as ``-`` and so differs from an empty one. An empty table gives no
    rows. Other columns, whatever their names, are not looked at.
    """
    key = fields[0]
    hashes = docs.select(
        F.col(key).alias("id"),
        F.col(group).cast("string").alias("tree"),
        leaf_hash(fields).alias("h"),
        F.when(F.lit(False) if where is None else where, leaf_hash(fields, **(changed or {}))).alias("now"),
    )
    # One row per document without its text; the number keeps repeated rows apart for the ranges.
    hashes = written(hashes.withColumn("copy", F.monotonically_increasing_id()), "leaves")
    leaves = written(numbered(hashes, ["tree"], ["id", "h", "copy"]).drop("copy"), "numbered")
    carried = ["id", "now"]
    forest = Forest(leaves, ["tree"], fanout, carried)
    tops = written(forest.tops, "subroots")
    everything = F.lit(0).alias("forest")
    heads = written(numbered(tops.select(everything, "tree", "h"), ["forest"], ["tree"]), "heads")
    crown = Forest(heads, ["forest"], fanout, ["tree"])
    nothing = F.array().cast(_PATH).alias("path")
    roots = crown.tops.select("forest", nothing, F.col("h").alias("root"))
    if crown.levels:
        above = crown.paths(roots, ["tree"])
    else:  # at most one source
        above = heads.join(F.broadcast(roots), "forest")
    above = written(above.select("tree", "path", "root", F.col("h").alias("subroot")), "above")
    columns = ["id", "h", "now", "path", "subroot", "root"]
    found = _matched(leaves.filter("n = 1"), above, ["tree"]).select(*columns)
    if forest.levels:
        found = found.unionByName(forest.paths(above, carried).select(*columns))
    texts = F.transform("path", lambda at: F.concat(at["before"], at["after"]))
    folded = fold(F.coalesce("now", "h"), F.col("path"))
    return found.select(
        F.col("id").alias(key),
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.sha2(F.array_join(texts, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def check_tampered(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of ``documents`` checked against copies of which some have A-Z in their text lower-cased.

    These are the documents whose id, in decimal, has an unsigned CRC32 divisible by ``TAMPERED``; null ids are not
    among them, and a text without A-Z stays what it was.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    found = manifest(docs, fanout=fanout, changed={"text": F.translate("text", _UPPER, _LOWER)}, where=hit)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
