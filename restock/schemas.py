"""Core tables: columns, natural keys, references and value checks, declared once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class CoreTable:
    """``schema`` is a DDL string; ``checks`` maps a rule name to a SQL condition rows must meet
    (a NULL condition passes, as for a SQL CHECK)."""

    name: str
    schema: str
    id_col: str
    unique: tuple[str, ...]
    required: tuple[str, ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema)

    @property
    def columns(self) -> list[str]:
        return self.struct.names


def _product_store(prefix: str) -> dict[str, tuple[str, str]]:
    return {f"{prefix}_p_id": ("products", "p_id"), f"{prefix}_s_id": ("stores", "s_id")}


_TABLES = [
    CoreTable(
        "productgroups", "pg_id BIGINT, pg_name STRING", "pg_id", ("pg_name",), ("pg_name",)
    ),
    CoreTable(
        "products",
        "p_id BIGINT, p_name STRING, p_group STRING, p_cluster STRING, p_is_perishable BOOLEAN",
        "p_id",
        ("p_name",),
        ("p_name",),
        defaults={"p_is_perishable": False},
    ),
    CoreTable(
        "stores",
        "s_id BIGINT, s_name STRING, s_city STRING, s_state STRING, s_country STRING, "
        "s_type STRING, s_cluster STRING, s_longitude DOUBLE, s_latitude DOUBLE",
        "s_id",
        ("s_name",),
        ("s_name",),
        checks={
            "longitude": "s_longitude BETWEEN -180 AND 180",
            "latitude": "s_latitude BETWEEN -90 AND 90",
        },
    ),
    CoreTable(
        "workshops",
        "w_id BIGINT, w_name STRING, w_capacity INT, w_longitude DOUBLE, w_latitude DOUBLE",
        "w_id",
        ("w_name",),
        ("w_name",),
        checks={
            "capacity": "w_capacity >= 0",
            "longitude": "w_longitude BETWEEN -180 AND 180",
            "latitude": "w_latitude BETWEEN -90 AND 90",
        },
    ),
    CoreTable(
        "transportlinks",
        "tl_id BIGINT, tl_p_id BIGINT, tl_s_id BIGINT, tl_w_id BIGINT, "
        "tl_package_cost DOUBLE, tl_package_size INT",
        "tl_id",
        ("tl_w_id", "tl_s_id", "tl_p_id"),
        ("tl_p_id", "tl_s_id", "tl_w_id", "tl_package_cost", "tl_package_size"),
        references={**_product_store("tl"), "tl_w_id": ("workshops", "w_id")},
        checks={"package_cost": "tl_package_cost >= 0", "package_size": "tl_package_size >= 0"},
    ),
    CoreTable(
        "procurements",
        "pc_id BIGINT, pc_p_id BIGINT, pc_s_id BIGINT, pc_active_from DATE, pc_active_upto DATE",
        "pc_id",
        ("pc_p_id", "pc_s_id", "pc_active_from", "pc_active_upto"),
        ("pc_p_id", "pc_s_id", "pc_active_from", "pc_active_upto"),
        references=_product_store("pc"),
        checks={"active_window": "pc_active_from < pc_active_upto"},
    ),
    CoreTable(
        "demandpredictions",
        "dp_id BIGINT, dp_p_id BIGINT, dp_s_id BIGINT, dp_date DATE, dp_mean INT",
        "dp_id",
        ("dp_p_id", "dp_s_id", "dp_date"),
        ("dp_p_id", "dp_s_id", "dp_date", "dp_mean"),
        references=_product_store("dp"),
        checks={"mean": "dp_mean >= 0"},
    ),
    CoreTable(
        "demandfulfillments",
        "df_id BIGINT, df_p_id BIGINT, df_s_id BIGINT, df_date DATE, df_initial_stocks INT, "
        "df_closing_stocks INT, df_met_demand INT, df_unmet_demand INT",
        "df_id",
        ("df_p_id", "df_s_id", "df_date"),
        ("df_p_id", "df_s_id", "df_date"),
        references=_product_store("df"),
        checks={
            "initial_stocks": "df_initial_stocks >= 0",
            "closing_stocks": "df_closing_stocks >= 0",
            "met_demand": "df_met_demand >= 0",
            "unmet_demand": "df_unmet_demand >= 0",
        },
    ),
    CoreTable(
        "procurementplans",
        "pl_id BIGINT, pl_p_id BIGINT, pl_s_id BIGINT, pl_w_id BIGINT, pl_date DATE, "
        "pl_expected_units INT",
        "pl_id",
        ("pl_p_id", "pl_s_id", "pl_w_id", "pl_date"),
        ("pl_p_id", "pl_s_id", "pl_w_id", "pl_date", "pl_expected_units"),
        references={**_product_store("pl"), "pl_w_id": ("workshops", "w_id")},
        checks={"expected_units": "pl_expected_units >= 0"},
    ),
    CoreTable(
        "sales",
        "sa_id BIGINT, sa_p_id BIGINT, sa_s_id BIGINT, sa_date DATE, sa_units_sold INT",
        "sa_id",
        ("sa_p_id", "sa_s_id", "sa_date"),
        ("sa_p_id", "sa_s_id", "sa_date", "sa_units_sold"),
        references=_product_store("sa"),
        checks={"units_sold": "sa_units_sold >= 0"},
    ),
    CoreTable(
        "promotions",
        "pr_id BIGINT, pr_p_id BIGINT, pr_s_id BIGINT, pr_date DATE",
        "pr_id",
        ("pr_p_id", "pr_s_id", "pr_date"),
        ("pr_p_id", "pr_s_id", "pr_date"),
        references=_product_store("pr"),
    ),
    CoreTable(
        "stocks",
        "sk_id BIGINT, sk_p_id BIGINT, sk_s_id BIGINT, sk_date DATE, sk_units INT",
        "sk_id",
        ("sk_p_id", "sk_s_id", "sk_date"),
        ("sk_p_id", "sk_s_id", "sk_date"),
        references=_product_store("sk"),
        checks={"units": "sk_units >= 0"},
        defaults={"sk_units": 0},
    ),
    CoreTable(
        "events",
        "e_id BIGINT, e_name STRING, e_type STRING, e_locality STRING",
        "e_id",
        ("e_name",),
        ("e_name",),
    ),
    CoreTable(
        "eventstores",
        "es_id BIGINT, es_e_id BIGINT, es_s_id BIGINT, es_date DATE",
        "es_id",
        ("es_e_id", "es_s_id", "es_date"),
        ("es_e_id", "es_s_id", "es_date"),
        references={"es_e_id": ("events", "e_id"), "es_s_id": ("stores", "s_id")},
    ),
]

CORE_TABLES: dict[str, CoreTable] = {table.name: table for table in _TABLES}
