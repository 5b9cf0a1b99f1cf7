"""Upserts, versions, amendments, references, cells and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def upsert(batches: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key: a later row replaces all fields."""
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return batches.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` and those of `rows` whose key isn't there yet; of equal keys among `rows`, one stays (the smallest row)."""
    rest = [c for c in rows.columns if c not in keys]
    fresh = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"))


def partial_upsert(batches: DataFrame, keys: list[str], last: list[str], first: list[str], seq: str = "seq") -> DataFrame:
    """One row of each key: `last` columns from its last row, `first` columns from its first."""
    return batches.groupBy(*keys).agg(*[F.max_by(c, seq).alias(c) for c in last], *[F.min_by(c, seq).alias(c) for c in first])


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def set_review_status(standards: DataFrame, passed: DataFrame) -> DataFrame:
    """standards with review_status passed or pending_review by the gate's result (standard_id, passed); others keep theirs."""
    return standards.join(passed.select("standard_id", F.col("passed").alias("_passed")), "standard_id", "left").withColumn("review_status", F.when(F.col("_passed"), "passed").when(~F.col("_passed"), "pending_review").otherwise(F.col("review_status"))).drop("_passed")


def version_chain(versions: DataFrame, as_of: Column, family: str = "family", effective: str = "effective", ident: str = "standard_id") -> DataFrame:
    """versions with status, replaces and replaced_by: of each family, the last one in effect is current, earlier ones are retired, later ones are coming."""
    order = Window.partitionBy(family).orderBy(effective, ident)
    following = F.lead(effective).over(order)
    status = F.when(F.col(effective) > as_of, T.COMING).when(following.isNull() | (following > as_of), T.CURRENT).otherwise(T.RETIRED)
    return versions.select("*", status.alias("status"), F.lag(ident).over(order).alias("replaces"), F.lead(ident).over(order).alias("replaced_by"))


def apply_changes(standards: DataFrame, changes: DataFrame) -> DataFrame:
    """standards (standard_id, standard_no, status) with replaced_by after changes (standard_id, action, new_id, new_no).

    add: a current standard of the new id; revise: that too, and the named one is retired in its favour; retire: the named one is retired.
    A new id that exists already isn't added again.
    """
    ended = changes.filter(F.col("action").isin("revise", "retire")).groupBy("standard_id").agg(F.max("new_id").alias("replaced_by"), F.lit(True).alias("_ended"))
    old = standards.select("standard_id", "standard_no", "status").join(ended, "standard_id", "left")
    kept = old.select("standard_id", "standard_no", F.when(F.col("_ended"), T.RETIRED).otherwise(F.col("status")).alias("status"), "replaced_by")
    added = changes.filter(F.col("action").isin("add", "revise")).select(F.col("new_id").alias("standard_id"), F.col("new_no").alias("standard_no"), F.lit(T.CURRENT).alias("status"), F.lit(None).cast("string").alias("replaced_by"))
    return insert_new(kept, added, ["standard_id"])


def reindex(tree: DataFrame, amended: DataFrame) -> DataFrame:
    """(node_id, reason): the nodes whose chunks change with the amended nodes (node_id): these themselves, and their children, whose context holds their text."""
    own = tree.join(amended.select("node_id").distinct(), "node_id", "left_semi").select("node_id", F.lit("amended").alias("reason"))
    below = tree.join(amended.select(F.col("node_id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("node_id", F.lit("parent amended").alias("reason"))
    return own.unionByName(below).groupBy("node_id").agg(F.min("reason").alias("reason"))


def supersede(clauses: DataFrame, amendments: DataFrame, include_history: bool = False) -> DataFrame:
    """Clauses without those that a current amendment (supersedes, revision_source) replaces; with include_history they stay, flagged."""
    current = amendments.filter(F.col("status") == T.CURRENT).groupBy(F.col("supersedes").alias("clause_id")).agg(F.min("revision_source").alias("revision_source"))
    if not include_history:
        return clauses.join(current, "clause_id", "left_anti")
    met = clauses.join(current, "clause_id", "left")
    return met.withColumn("revised", F.col("revision_source").isNotNull())


def expand_references(hits: DataFrame, refs: DataFrame, admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(auxiliary rows, warnings) one step from hits (question_id, clause_id) along refs (clause_id, target_id).

    Targets that were hit already, self-references and targets that aren't in `admitted` (clause_id, status) give no row; those that are retired there
    give a warning.
    """
    steps = hits.select("question_id", "clause_id").join(refs, "clause_id").filter("clause_id != target_id").select("question_id", F.col("target_id").alias("clause_id")).distinct()
    fresh = steps.join(hits.select("question_id", "clause_id"), ["question_id", "clause_id"], "left_anti").join(admitted.select("clause_id", "status"), "clause_id")
    aux = fresh.filter(F.col("status") == T.CURRENT).select("question_id", "clause_id", F.lit(True).alias("is_aux"))
    return aux, fresh.filter(F.col("status") != T.CURRENT).select("question_id", "clause_id", "status")


def locate_cells(asked: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(question_id, table_id, n_cells, answer): the cell at asked (question_id, table_id, row_header, col_header, unit) if there is exactly one, else the table's Markdown. An empty unit admits any."""
    met = asked.alias("q").join(cells.alias("c"), (F.col("q.table_id") == F.col("c.table_id")) & (F.col("q.row_header") == F.col("c.row_header")) & (F.col("q.col_header") == F.col("c.col_header")) & ((F.col("q.unit") == "") | (F.col("q.unit") == F.col("c.unit"))), "left")
    counted = met.groupBy("q.question_id", "q.table_id").agg(F.count("c.cell_text").alias("n_cells"), F.min("c.cell_text").alias("cell"))
    return counted.join(tables.select("table_id", "table_markdown"), "table_id", "left").select("question_id", "table_id", "n_cells", F.when(F.col("n_cells") == 1, F.col("cell")).otherwise(F.col("table_markdown")).alias("answer"))


def reconcile(truth: DataFrame, index: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action): what the index needs to equal the truth: insert, delete, update or ok."""
    t, i = truth.select(key, F.lit(True).alias("_t"), *[F.col(f).alias(f"t_{f}") for f in fields]), index.select(key, F.lit(True).alias("_i"), *[F.col(f).alias(f"i_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"t_{f}").eqNullSafe(F.col(f"i_{f}"))
    return t.join(i, key, "full_outer").select(key, F.when(F.col("_i").isNull(), "insert").when(F.col("_t").isNull(), "delete").when(~same, "update").otherwise("ok").alias("action"))


def enrich(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Chunks with keywords (sorted) and common questions of metadata (node_id, keywords, common_questions) added to the retrieval text."""
    more = metadata.select("node_id", F.concat_ws(" ", F.array_join(F.array_sort("keywords"), " "), F.array_join("common_questions", " ")).alias("more"))
    return chunks.join(more, "node_id", "left").withColumn("retrieval_text", F.when(F.coalesce("more", F.lit("")) != "", F.concat_ws(" ", "retrieval_text", "more")).otherwise(F.col("retrieval_text"))).drop("more")


def filter_blocks(blocks: DataFrame, least: float) -> DataFrame:
    """Blocks of sufficient quality; an unknown quality isn't."""
    return blocks.filter(F.coalesce("quality_score", F.lit(0.0)) >= least)


def block_clauses(blocks: DataFrame, page_map: DataFrame) -> DataFrame:
    """(block_id, node_id): the related node, or those of the block's page."""
    related = blocks.filter("related_node_id is not null").select("block_id", F.col("related_node_id").alias("node_id"))
    paged = blocks.filter("related_node_id is null").join(page_map, ["standard_id", "page_no"]).select("block_id", "node_id")
    return related.unionByName(paged)
