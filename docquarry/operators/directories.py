"""Directory documents: the named tree queries, full paths, slots and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from docquarry.functions.values import number_at, text_at
from docquarry.plans.query import Q, and_, find
from docquarry.session import cut_lineage

OWNER = "parent_doc_id"
PARENT = "parent_directory_id"


def _dependency(name: str):
    hit = F.filter("depends_on", lambda d: d["name"] == name)
    return F.coalesce(F.get(hit, F.lit(0))["document_id"], F.lit(""))


def directories_of(df: DataFrame, owner_id: str) -> DataFrame:
    return find(df, and_(Q("", "isa", "directory"), Q("", "depends_on", OWNER, owner_id)))


def children_of(df: DataFrame, directory_id: str) -> DataFrame:
    return find(df, and_(Q("", "isa", "directory"), Q("", "depends_on", PARENT, directory_id)))


def top_level_directories(df: DataFrame, owner_id: str) -> DataFrame:
    return directories_of(df, owner_id).where(_dependency(PARENT) == "")


def directory_edges(df: DataFrame) -> DataFrame:
    """(id, dirname, role, owner, parent) of every directory document."""
    return find(df, Q("", "isa", "directory")).select(
        "id",
        text_at(df, "directory.dirname").alias("dirname"),
        text_at(df, "directory.directory_role").alias("directory_role"),
        _dependency(OWNER).alias("owner_id"),
        _dependency(PARENT).alias("parent_id"),
    )


def directory_tree(edges: DataFrame) -> DataFrame:
    """Full path and depth of every directory reachable from a top-level one.

    By pointer doubling: a directory holds the piece of path below one of its ancestors, and each
    round puts the piece that this ancestor holds before it.  Pieces double, so a tree of depth d
    takes about log2(d) rounds of one join.  A directory is finished when its piece begins at
    a top level.  Round r finishes the depths from 2**r on; a round that finishes nothing
    leaves only directories of a cycle, or below one, which have no top level and stay out, as
    do those under a parent that doesn't exist.  Each round is written to the shared folder, so
    plans stay short and lost executors cost one round.

    Of directories that share an id one is placed: a top-level one, else that of smallest (dirname,
    owner, parent).
    """
    top = F.col("parent_id") == ""
    first = F.min(F.struct((~top).alias("below"), "dirname", "owner_id", "parent_id"))
    nodes = edges.groupBy("id").agg(first.alias("n")).select("id", "n.*")
    # up: the ancestor that comes next (NULL: finished), path: the piece below it, depth: its length
    state = cut_lineage(
        nodes.select(
            "id", "owner_id", F.when(~top, F.col("parent_id")).alias("up"), F.col("dirname").alias("path"),
            F.when(top, 0).otherwise(1).alias("depth"),
        ),
        "tree",
    )
    finished, open_ = [state.where("up is null")], state.where("up is not null")
    while True:
        above = reduce(DataFrame.unionByName, [*finished, open_]).select(
            F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("depth").alias("__depth")
        )
        state = cut_lineage(
            open_.join(above, F.col("up") == F.col("__id")).select(
                "id", "owner_id", F.col("__up").alias("up"), F.concat("__path", F.lit("/"), "path").alias("path"),
                (F.col("__depth") + F.col("depth")).alias("depth"),
            ),
            "tree",
        )
        newly, open_ = state.where("up is null"), state.where("up is not null")
        if newly.isEmpty():
            return reduce(DataFrame.unionByName, finished).select("id", "owner_id", "path", "depth")
        finished.append(newly)


def slot(df: DataFrame, owners: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """Directories filling a named slot of their owner: (owner_id, directory_role, id)."""
    filled = directory_edges(df).where("directory_role <> ''")
    if role is not None:
        filled = filled.where(F.col("directory_role") == role)
    pairs = filled.select("owner_id", "directory_role", "id")
    if owners is None:
        return pairs
    ids = owners.select(F.col("id").alias("owner_id")).distinct()
    return pairs.join(ids, "owner_id", "left_semi")


def manifest_entries(directories: DataFrame, manifests: DataFrame, filename: str | None = None) -> DataFrame:
    """The files a directory lists."""
    files = manifests if filename is None else manifests.where(F.col("filename") == filename)
    return files.join(directories.select(F.col("id").alias("directory_id")), "directory_id", "left_semi")


def manifest_count_errors(directories: DataFrame, manifests: DataFrame) -> DataFrame:
    """Directories whose ``num_entries`` differs from the rows of their manifest."""
    counts = manifests.groupBy("directory_id").agg(F.count(F.lit(1)).alias("n_rows"))
    declared = directories.select("id", number_at(directories, "directory.num_entries").cast("long").alias("num_entries"))
    joined = declared.join(counts, F.col("id") == F.col("directory_id"), "left")
    n_rows = F.coalesce("n_rows", F.lit(0))
    return joined.where(n_rows != F.col("num_entries")).select("id", "num_entries", n_rows.alias("n_rows"))
