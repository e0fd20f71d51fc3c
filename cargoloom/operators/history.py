"""Change capture: old/new comparison, notices, recipients, revisions, validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import keep_if
from .ordering import ordinal, running_max


def unread_flags(page: DataFrame, t, key: str, module: str, user_id, company_id=None) -> DataFrame:
    """``isBellAlert`` = 1 where the user has an unread notice about the record."""
    notices = keep_if(t.actionNotification.where(F.col("sourceModule") == module), "corporateId", company_id)
    unread = t.notificationRecipient.where((F.col("userID") == user_id) & (F.col("isRead").cast("int") == 0))
    records = (notices.join(unread, notices["actionNotificationID"] == unread["notificationID"], "left_semi")
               .select(F.col("corporateId").alias("_bc"), F.col("sourceRecordId").alias("_bell")).distinct())
    return page.join(records, (F.col(key) == F.col("_bell")) & (F.col("companyId") == F.col("_bc")), "left") \
        .withColumn("isBellAlert", F.when(F.col("_bell").isNull(), 0).otherwise(1)).drop("_bell", "_bc")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``columns`` differ between two images, as (key, keep.., column, oldValue, newValue) text rows.

    Images pair on the row key, so a line is compared with itself only.  A NULL
    on one side counts as a change; equal values, or NULL on both sides, do not.
    """
    o = old.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(f"_o{i}") for i, c in enumerate(columns)])
    both = new.join(o, F.col(key) == F.col("_k"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_o{i}").alias("oldValue"),
                               F.col(c).cast("string").alias("newValue")) for i, c in enumerate(columns)])
    out = both.select(key, *keep, F.inline(F.filter(pairs, lambda p: ~p["oldValue"].eqNullSafe(p["newValue"]))))
    return out


def change_json(df: DataFrame, out: str = "payload") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct("column", "oldValue", "newValue")))


def target_date_notices(old: DataFrame, new: DataFrame, lines: DataFrame) -> DataFrame:
    """Work orders whose target date moved, as notices for the work order and for each of its sales orders."""
    moved = changed_rows(old, new, "workOrderHeaderId", ["targetCompleteDate"], ["companyId", "workOrderName"])
    moved = change_json(moved).select("workOrderHeaderId", "companyId", "workOrderName", "payload")
    return _work_order_notices(moved, lines, "TargetDateChange")


def line_qty_notices(old: DataFrame, new: DataFrame, headers: DataFrame) -> DataFrame:
    """Work-order lines whose quantity or confirmed quantity changed, as notices."""
    moved = changed_rows(old, new, "workOrderLineItemId", ["qty", "confirmQty"], ["workOrderHeaderId", "soHeaderId"])
    moved = change_json(moved).join(headers.select("workOrderHeaderId", "companyId"), "workOrderHeaderId")
    shape = ["companyId", "sourceModule", "sourceRecordId", "eventType", "payload"]
    event = F.concat(F.lit("Change "), "column").alias("eventType")
    of_work = moved.select("companyId", F.lit("WorkOrder").alias("sourceModule"), F.col("workOrderHeaderId").alias("sourceRecordId"), event, "payload")
    of_sale = moved.select("companyId", F.lit("SalesOrder").alias("sourceModule"), F.col("soHeaderId").alias("sourceRecordId"), event, "payload")
    return of_work.unionByName(of_sale).select(*shape).distinct()


def _work_order_notices(moved: DataFrame, lines: DataFrame, event: str) -> DataFrame:
    of_work = moved.select("companyId", F.lit("WorkOrder").alias("sourceModule"),
                           F.col("workOrderHeaderId").alias("sourceRecordId"), F.lit(event).alias("eventType"), "payload")
    orders = lines.select("workOrderHeaderId", "soHeaderId").distinct()
    of_sale = moved.join(orders, "workOrderHeaderId").select(
        "companyId", F.lit("SalesOrder").alias("sourceModule"), F.col("soHeaderId").alias("sourceRecordId"),
        F.lit(event).alias("eventType"), "payload")
    return of_work.unionByName(of_sale).distinct()


# Which roles hear about which module.
ROLE_MODULES = [("planning", "WorkOrder"), ("loading", "WorkOrder"), ("sales", "SalesOrder")]
# Copies of each company's users that its notices are dealt out over.
NOTICE_COPIES = 64


def notify_recipients(notices: DataFrame, t, exclude_user: int | None = None) -> DataFrame:
    """Notices x active users of the company in a role that follows the module."""
    module = F.when(F.lower("roleName").isin(*[r for r, m in ROLE_MODULES if m == "WorkOrder"]), "WorkOrder") \
        .when(F.lower("roleName").isin(*[r for r, m in ROLE_MODULES if m == "SalesOrder"]), "SalesOrder")
    roles = t.userRole.join(t.companyRole, F.col("userrolecompanyroleid") == F.col("companyRoleId")) \
        .join(t.md_Role, "roleId").join(t.md_User.where(F.col("status") == 1).select("userId"), "userId") \
        .select("companyId", "userId", module.alias("sourceModule"), F.col("roleName").alias("notifyGroup"))
    if exclude_user is not None:
        roles = roles.where(F.col("userId") != exclude_user)
    # there are few pairs of company and module, so the notices of one are dealt out over NOTICE_COPIES copies of its users;
    # the number of partitions is fixed, as adaptive execution would put so few rows into one task
    by = ["companyId", "sourceModule", "_turn"]
    roles = roles.where(F.col("sourceModule").isNotNull()).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(NOTICE_COPIES - 1)))).repartition(NOTICE_COPIES, *by)
    dealt = notices.withColumn("_turn", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in notices.columns]), F.lit(NOTICE_COPIES)).cast("int")).repartition(NOTICE_COPIES, *by)
    return dealt.join(roles, by).drop("_turn") \
        .withColumn("isRead", F.lit(0))


def audit_feed(changes: DataFrame, document: str, order_by: Sequence[str], revision: DataFrame | None = None) -> DataFrame:
    """Change rows with a revision number per document (continuing ``revision``) and their JSON."""
    numbered = ordinal(change_json(changes), order_by, within=[document], name="revisionNo")
    if revision is not None:
        last = revision.select(F.col(document).alias("_d"), F.col("revision").alias("_r"))
        numbered = numbered.join(last, F.col(document) == F.col("_d"), "left") \
            .withColumn("revisionNo", F.col("revisionNo") + F.coalesce("_r", F.lit(0))).drop("_d", "_r")
    return numbered


def build_history(changes: DataFrame, key: str, at: str, sequence: str) -> DataFrame:
    """Change rows -> versions with ``ValidFrom`` and ``ValidTo`` (NULL while current).

    The next change of the same key is found by pairing each row's position with
    the following one, so a key with very many changes is not one task's work.
    """
    placed = ordinal(changes, [at, sequence], within=[key], name="_n")
    nxt = placed.select(F.col(key).alias("_k"), (F.col("_n") - 1).alias("_m"), F.col(at).alias("ValidTo"))
    return placed.join(nxt, (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("_m")), "left") \
        .withColumnRenamed(at, "ValidFrom").drop("_k", "_m", "_n")


def as_of(history: DataFrame, at) -> DataFrame:
    """Row versions valid at one moment."""
    moment = F.lit(at).cast(history.schema["ValidFrom"].dataType)
    return history.where((F.col("ValidFrom") <= moment) & (F.col("ValidTo").isNull() | (moment < F.col("ValidTo"))))


def as_of_join(probe: DataFrame, history: DataFrame, key: str, at: str, row_key: str) -> DataFrame:
    """For each probe row, the version of its key that was valid at the row's time.

    Versions and probes are laid out together in (key, time) order and the last
    version so far is carried down, so a key with many versions and many probes
    is never compared pair by pair.
    """
    versions = [c for c in history.columns if c != key]
    payload = F.struct("ValidFrom", *[c for c in versions if c != "ValidFrom"])
    h = history.select(F.col(key).alias("_k"), F.col("ValidFrom").alias("_t"), F.lit(0).alias("_side"), payload.alias("_version"),
                       F.lit(None).cast(probe.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_probe"))
    p = probe.select(F.col(key).alias("_k"), F.col(at).cast(history.schema["ValidFrom"].dataType).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(h.schema["_version"].dataType).alias("_version"), F.struct("*").alias("_probe"))
    laid = running_max(h.unionByName(p), ["_t", "_side", F.col(f"_probe.{row_key}")], ["_k"], _last=F.col("_version"))
    valid = F.col("_last.ValidTo").isNull() | (F.col("_t") < F.col("_last.ValidTo"))
    return laid.where(F.col("_side") == 1).select(
        "_probe.*", *[F.when(valid, F.col(f"_last.{c}")).alias(c) for c in versions])


def default_naming(types: DataFrame, categories: DataFrame, companies: Sequence[int], parent: int, template: str) -> DataFrame:
    """New item types below a category of the given companies get a naming template when they have none."""
    scope = categories.where(F.col("companyId").isin(*companies) & (F.col("prodCategoryParentID") == parent)) \
        .select(F.col("prodCategoryId").alias("_c")).distinct()
    return types.join(scope, F.col("prodCategoryId") == F.col("_c"), "left") \
        .withColumn("namingConvention", F.when(F.col("_c").isNotNull() & (F.coalesce("namingConvention", F.lit("")) == ""), template)
                    .otherwise(F.col("namingConvention"))).drop("_c")
