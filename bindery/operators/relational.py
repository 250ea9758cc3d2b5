"""Listings, versions, look-ups and nested views over submissions, documents and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.operators.ranking import number_within


# --- pages of a listing -----------------------------------------------------
def page_of(items: DataFrame, order: list[Column], page: int = 1, page_size: int = 50) -> DataFrame:
    """One page in ``order`` with its envelope: total, page, page_size and pages.

    Sort, offset and limit become one top-k; the total is a scalar subquery of
    the same filtered rows, so nothing is joined.
    """
    total = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long")
    return (items.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
            .withColumn("total", total)
            .withColumns({"page": F.lit(page), "page_size": F.lit(page_size), "pages": pages}))


def newest_first(key: str, at: str = "created_at") -> list[Column]:
    return [F.col(at).desc(), F.col(key)]


def filter_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; a filter that is None does not apply."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


# --- submissions ------------------------------------------------------------
def with_user_names(submissions: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the names of the assigned underwriter and of the creator."""
    def names(out: str, key: str) -> DataFrame:
        return users.select(F.col("user_id").alias(key), F.col("full_name").alias(out))
    return (submissions.join(names("assigned_name", "assigned_to"), "assigned_to", "left")
            .join(names("creator_name", "created_by"), "created_by", "left"))


def list_submissions(submissions: DataFrame, users: DataFrame, *, status: str | None = None,
                     assigned_to: int | None = None, created_by: int | None = None,
                     page: int = 1, page_size: int = 50) -> DataFrame:
    """Filtered page, newest first; names are joined to the page only."""
    chosen = filter_equal(submissions, status=status, assigned_to=assigned_to, created_by=created_by)
    return with_user_names(page_of(chosen, newest_first("submission_id"), page, page_size), users)


def document_counts(submissions: DataFrame, documents: DataFrame) -> DataFrame:
    """Current documents per submission, 0 where there are none."""
    counts = documents.filter("is_current_version").groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return submissions.select("submission_id").join(counts, "submission_id", "left").fillna(0, ["n_documents"])


def number_submissions(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``SUB-YYYYMMDD-NNNN``, counted on from the existing submissions of the day."""
    dated = new.withColumn("_day", F.date_format("created_at", "yyyyMMdd"))
    numbered = number_within(dated, ["_day"], ["created_at", "submission_id"], "_n")
    if existing is not None:
        taken = existing.groupBy(F.substring("submission_number", 5, 8).alias("_day")).agg(F.count(F.lit(1)).alias("_taken"))
        numbered = numbered.join(taken, "_day", "left").withColumn("_n", F.col("_n") + F.coalesce("_taken", F.lit(0))).drop("_taken")
    padded = F.when(F.col("_n") < 10_000, F.lpad(F.col("_n").cast("string"), 4, "0")).otherwise(F.col("_n").cast("string"))
    return numbered.withColumn("submission_number", F.concat_ws("-", F.lit("SUB"), "_day", padded)).drop("_day", "_n")


def callers(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(caller_id, role) of every user."""
    return users.join(roles, "role_id").select(F.col("user_id").alias("caller_id"), F.col("name").alias("role"))


def visible_counts(rows: DataFrame, callers: DataFrame, owner: str = "created_by", key: str = "submission_id") -> DataFrame:
    """How many rows each caller sees, and the first of them; ADMINs see all.

    Counted per owner first, so nobody's rows are repeated for each caller.
    """
    per_owner = rows.groupBy(F.col(owner).alias("caller_id")).agg(
        F.count(F.lit(1)).alias("n_visible"), F.min(key).alias("first_id"))
    own = callers.filter("role <> 'ADMIN'").join(per_owner, "caller_id").select("caller_id", "n_visible", "first_id")
    total = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).alias("all")).scalar()
    everything = callers.filter("role = 'ADMIN'").withColumn("_all", total).select(
        "caller_id", F.col("_all.n").alias("n_visible"), F.col("_all.first").alias("first_id"))
    return own.unionByName(everything)


def visible_rows(rows: DataFrame, role: str, user_id, owner: str = "created_by") -> DataFrame:
    """What one caller may see; a plain filter that reaches the scan."""
    return rows if role == "ADMIN" else rows.filter(F.col(owner) == F.lit(user_id))


def patch(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Overwrites attributes with the patch's non-null values."""
    changed = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    merged = {c: F.coalesce(f"_new_{c}", c) for c in changed}
    return base.join(renamed, key, "left").select(
        *[(merged[c].alias(c) if c in merged else F.col(c)) for c in base.columns])


def with_documents(submissions: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """Each submission with its people and its documents, one row a document in ``ordinal`` order.

    A submission without documents has one row whose ordinal is null. The shape
    is the same whatever the number of documents.
    """
    numbered = number_within(documents.select("submission_id", "document_id", "original_filename", "document_type"),
                             ["submission_id"], ["document_id"], "ordinal")
    return with_user_names(submissions, users).join(numbered, "submission_id", "left")


def dashboard(submissions: DataFrame) -> DataFrame:
    """Submissions by status with the overall total."""
    by_status = submissions.groupBy("status").agg(F.count(F.lit(1)).alias("n_submissions"))
    return by_status.withColumn("total", submissions.agg(F.count(F.lit(1)).alias("n")).scalar())


def recent(submissions: DataFrame, n: int = 5) -> DataFrame:
    return submissions.orderBy(*newest_first("submission_id")).limit(n)


# --- documents --------------------------------------------------------------
def documents_of(documents: DataFrame, submission_id, current_only: bool = True) -> DataFrame:
    chosen = documents.filter(F.col("submission_id") == F.lit(submission_id))
    return (chosen.filter("is_current_version") if current_only else chosen).orderBy("uploaded_at", "document_id")


def assign_versions(documents: DataFrame) -> DataFrame:
    """Uploads of one filename get versions 1, 2, ...; the newest is current. One shuffle."""
    return number_within(documents, ["submission_id", "original_filename"], ["uploaded_at", "document_id"],
                         "version_number", last="is_current_version")


def append_version(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """New uploads (at most one per filename) beside existing documents.

    Earlier versions stop being current; the number is the highest one plus 1,
    or 1 when no earlier version was current.
    """
    keys = ["submission_id", "original_filename"]
    known = documents.groupBy(*keys).agg(F.max("version_number").alias("_max"),
                                         F.max("is_current_version").alias("_any_current"))
    added = uploads.join(known, keys, "left").withColumns({
        "version_number": F.when(F.col("_any_current"), F.col("_max") + 1).otherwise(1),
        "is_current_version": F.lit(True)}).drop("_max", "_any_current")
    replaced = uploads.select(*keys).distinct().withColumn("_replaced", F.lit(True))
    kept = documents.join(replaced, keys, "left").withColumn(
        "is_current_version", F.col("is_current_version") & F.col("_replaced").isNull()).drop("_replaced")
    return kept.unionByName(added)


def version_history(versioned: DataFrame) -> DataFrame:
    """All versions of every filename, sorted by submission and filename, oldest first within a filename."""
    return versioned.select("submission_id", "original_filename", "version_number", "document_id", "uploaded_at",
                            "file_size_bytes", "is_current_version") \
        .orderBy("submission_id", "original_filename", "version_number")


# --- users ------------------------------------------------------------------
def user_directory(users: DataFrame, roles: DataFrame, *, is_active: bool | None = None, role: str | None = None,
                   page: int = 1, page_size: int = 50) -> DataFrame:
    named = users.join(roles.withColumnRenamed("name", "role_name"), "role_id")
    return page_of(filter_equal(named, is_active=is_active, role_name=role), newest_first("user_id"), page, page_size)


def normal_email(c: Column | str) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def lookup(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` for a batch of keys."""
    return table.join(batch.select(key).distinct(), key, "left_semi")


def existence(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The batch with ``exists`` saying whether ``table`` has the key."""
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    return batch.join(known, key, "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")
