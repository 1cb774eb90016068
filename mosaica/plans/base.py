"""Registration of queries, and the SQL views that their oracle statements share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_ANC = "(p_partkey // (11 + s_suppkey % 13) + s_suppkey + {h} * (s_suppkey % 5)) % 2"
_ALLELE = "CAST(CASE WHEN (p_partkey * 7919 + s_suppkey * 104729 + {h} * 1299709 + (p_partkey * s_suppkey) % 101) % 97 < 10 + (p_partkey * 37) % 60 + 15 * ({c}) THEN 1 ELSE 0 END AS INT)"

#: Views by name; each may use those before it.
VIEWS: dict[str, str] = {
    "geno": "SELECT p_partkey AS snp, s_suppkey AS indiv, "
    + ", ".join(f"{_ALLELE.format(h=h, c=_ANC.format(h=h))} AS a{h}" for h in (0, 1))
    + ", "
    + ", ".join(f"CAST({_ANC.format(h=h)} AS INT) AS c{h}" for h in (0, 1))
    + " FROM part CROSS JOIN supplier",
    "haps": "SELECT snp, indiv, 0 AS ploidy, a0 AS allele, c0 AS anc FROM geno UNION ALL SELECT snp, indiv, 1, a1, c1 FROM geno",
    "apa": "SELECT snp, indiv, a0 * CAST(c0 = 0 AS INT) + a1 * CAST(c1 = 0 AS INT) AS g1, a0 * c0 + a1 * c1 AS g2, 2 - c0 - c1 AS l1, a0 + a1 AS g FROM geno",
    "snps": "SELECT p_partkey AS snp, CAST(p_partkey // 40 AS INT) AS chrom, p_partkey * 1000 + p_size AS pos, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, "
    "substr('CGTA', CAST(1 + p_partkey % 4 AS INT), 1) AS alt, p_retailprice / 1000 AS weight, p_size AS size, p_brand AS brand FROM part",
    "indivs": "SELECT s_suppkey AS indiv, s_name AS name, s_acctbal AS pheno, CAST(s_acctbal > 4500 AS INT) AS affected, s_nationkey AS cov, n_name AS pop, r_name AS superpop "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ends": "SELECT indiv, snp + 1 AS stop, c0 AS anc0, c1 AS anc1 FROM (SELECT *, lead(c0 * 10 + c1) OVER (PARTITION BY indiv ORDER BY snp) AS nxt FROM geno) WHERE nxt IS NULL OR nxt <> c0 * 10 + c1",
    "segs": "SELECT indiv, lag(stop, 1, 0) OVER (PARTITION BY indiv ORDER BY stop) AS start, stop, anc0, anc1 FROM ends",
}


def with_views(sql: str) -> str:
    """Put the views that a statement names in front of it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            # Adding zero turns a rounded -0.0 into 0.0, as r6 does.
            ORACLE_SQL[name] = with_views(re.sub(r"\bround\(", "0e0 + round(", sql))
        return f

    return register


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded, with a plain zero for the negative one, under its own or a given name."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out
