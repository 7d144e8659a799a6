"""Who may see what: row ownership, role gates, column masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    """A user as the token names them; roles may be missing."""

    id: str | int
    roles: tuple[str, ...] = ()

    @property
    def is_admin(self) -> bool:
        return "admin" in self.roles

    def require(self, *roles: str) -> None:
        """Raises PermissionError without any of the roles."""
        if not set(roles) & set(self.roles):
            raise PermissionError(f"one of these roles is required: {', '.join(roles)}")


def visible(df: DataFrame, principal: Principal, owner: str = "owner") -> DataFrame:
    """All rows for an admin, else those that the principal owns. Comes before filters, counts and pages."""
    return df if principal.is_admin else df.where(F.col(owner) == F.lit(principal.id))


def find_one(df: DataFrame, principal: Principal, key: str, value, owner: str = "owner") -> DataFrame:
    """No row or one: a row of someone else is as absent as one that doesn't exist.

    A key that repeats is an error when the plan runs.
    """
    found = visible(df, principal, owner).where(F.col(key) == F.lit(value)).limit(2)
    n = F.count("*").over(_whole())
    checked = found.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"more than one {key}"))).otherwise(True))
    return checked.drop("__n")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()


def masked(df: DataFrame, principal: Principal, columns: dict[str, Column]) -> DataFrame:
    """Columns that only an admin sees take the given default for others."""
    return df if principal.is_admin else df.withColumns({c: default.cast(df.schema[c].dataType) for c, default in columns.items()})


def roles_of_token(payload: DataFrame, realm: str = "realm_access", client: str = "client_access") -> DataFrame:
    """Adds realm_roles, client_roles (empty where the token has none) and is_admin."""
    roles = lambda c: F.coalesce(F.col(f"{c}.roles"), F.array().cast("array<string>"))
    return payload.withColumns(
        {"realm_roles": roles(realm), "client_roles": roles(client), "is_admin": F.array_contains(roles(realm), "admin")}
    )


def has_any_role(roles: Column, *wanted: str) -> Column:
    return F.arrays_overlap(roles, F.array(*map(F.lit, wanted)))
