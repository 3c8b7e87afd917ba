"""Small SQL text builders shared by the DuckDB oracles."""

from __future__ import annotations


def unit_hash(expr: str, seed: int = 0) -> str:
    """SQL twin of landscape.functions.sampling.unit_hash."""
    return f"(CAST('0x' || substr(md5({expr} || '|{seed}'), 1, 8) AS BIGINT) / 4294967296.0E0)"


def nearest_quartiles(src: str, keys: list[str], value: str, prefix: str) -> str:
    """Nearest-rank quartiles (0-based rank floor((n-1)q + 0.5)) and mean."""
    k = ", ".join(keys)
    qs = ",\n  ".join(
        f"max(CASE WHEN rn - 1 = floor((n - 1) * {q} + 0.5) THEN {value} END) AS {prefix}{int(q * 100)}"
        for q in (0.25, 0.5, 0.75))
    return f"""
SELECT {k},
  {qs},
  avg({value}) AS {prefix}_mean
FROM (SELECT {k}, {value}, row_number() OVER (PARTITION BY {k} ORDER BY {value}) AS rn,
             count(*) OVER (PARTITION BY {k}) AS n FROM {src} WHERE {value} IS NOT NULL) q
GROUP BY {k}"""


def top_names(src: str, key: str, item: str, score: str, n: int, label: str | None = None,
              prefix: str = "") -> str:
    lab = label or item
    return f"""
SELECT {key}, '{prefix}' || string_agg({lab}, ', ' ORDER BY rn) AS names FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, {item}) AS rn FROM {src}) t
WHERE rn <= {n} GROUP BY {key}"""


def r6(cols: list[str], alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return ", ".join(f"round({a}{c}, 6) AS {c}" for c in cols)


def mean6(value: str, weight: str | None = None, scale: int = 3) -> str:
    """SQL twin of landscape.functions.exact.mean6."""
    k = f"CAST(round({value} * {10 ** scale}) AS BIGINT)"
    if weight is None:
        s, n = f"sum({k})", f"count({k})"
    else:
        s, n = f"sum({k} * {weight})", f"sum(CASE WHEN {value} IS NOT NULL THEN {weight} END)"
    return f"CAST(sign({s}) * floor((2 * abs({s}) * {10 ** (6 - scale)} + {n}) / (2 * {n})) / 1e6 AS DOUBLE)"
