"""DuckDB SQL fragments shared by oracle queries."""

from docweave.functions import text as tx


def sq_l2(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))")


def dot(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))")


def cosine(a: str, b: str) -> str:
    den = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE {dot(a, b)} / {den} END)"


WS = tx.WS
WORD = tx.WORD


def normalize_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def ustrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
