"""Role-based permission flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import keep_if


def user_permission(t, user_id=None, company_id=None, menu=None) -> DataFrame:
    """Add/edit/delete flags by user, company and menu entry."""
    roles = keep_if(t.companyRole, "companyId", company_id).join(t.md_Role, "roleId")
    grants = keep_if(t.companyRoleFunction, "menuLevel2Id", menu)
    users = t.userRole if user_id is None else t.userRole.where(F.col("userId") == user_id)
    return (roles.join(grants, "companyRoleId")
            .join(users, F.col("userrolecompanyroleid") == F.col("companyRoleId"))
            .select("userId", "companyId", "menuLevel2Id", "roleName", "functionAdd", "functionEdit", "functionDelete"))


def may_add(t, user_id, company_id, menu):
    """Scalar 1/0: the user may add under the menu entry in the company."""
    return user_permission(t, user_id, company_id, menu).select(F.coalesce(F.max("functionAdd"), F.lit(0))).scalar()
