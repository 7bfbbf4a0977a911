"""The functions of symbols.py and arrays.py as text of DuckDB's SQL, for the oracle queries."""

from __future__ import annotations

from atomloom.functions import symbols as S


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def singular(w: str, guarded: bool = False) -> str:
    first = f"length({w}) <= 3" + (f" or {w} in ({quoted(S.INVARIANT_WORDS)})" if guarded else "")
    ends = f" when regexp_matches({w}, '({'|'.join(S.INVARIANT_ENDINGS)})$') then {w}" if guarded else ""
    return f"case when {first} then {w} when {w} like '%ies' and length({w}) > 4 then left({w}, length({w}) - 3) || 'y' when {w} like '%ses' and length({w}) > 4 then left({w}, length({w}) - 2){ends} when {w} like '%s' and not regexp_matches({w}, '(ss|us|is)$') then left({w}, length({w}) - 1) else {w} end"


def plural(w: str) -> str:
    return f"case when {w} like '%y' and length({w}) > 2 then left({w}, length({w}) - 1) || 'ies' when regexp_matches({w}, '(s|x|z|ch|sh)$') then {w} || 'es' else {w} || 's' end"


def snake(x: str, keep_case: bool = False) -> str:
    out = rf"regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
    return out if keep_case else f"lower({out})"


def canonical(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({snake(x)}, '_'), lambda p: p <> ''), lambda p: {singular('p')}), '_')"


def pascal(x: str) -> str:
    return f"case when {x} in ({quoted(S.PASCAL_KEPT)}) then {x} else array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9]+'), lambda p: p <> ''), lambda p: upper(p[1]) || lower(p[2:])), '') end"


def value(x: str) -> str:
    token = rf"case when regexp_matches(p, '^[$?]|-|\d') then p else {singular('lower(p)', True)} end"
    return rf"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[\s\p{{Z}}]+'), lambda p: p <> ''), lambda p: {token}), '-')"


def predicate(x: str) -> str:
    return f"replace(lower({strip(x)}), ' ', '-')"


def phrase(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({norm(x)}, ' '), lambda w: w <> '' and w not in ({quoted(S.ARTICLES)})), lambda w: {singular('w')}), '_')"


def ordered_distinct(rows: str, key: str, pos: str, val: str) -> str:
    """A CTE body: per key the values in order of their first place, joined by commas. rows is the name of a relation."""
    return f"select {key}, string_agg({val}, ',' order by p) joined from (select {key}, {val}, min({pos}) p from {rows} group by all) group by all"
