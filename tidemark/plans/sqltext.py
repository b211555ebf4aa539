"""SQL spellings of the scalar functions, for the oracle texts."""

from __future__ import annotations


def sql_space(x: str) -> str:
    return rf"coalesce(trim(regexp_replace({x}, '[\s\p{{Z}}\x0b\x85\x1c-\x1f]+', ' ', 'g')), '')"


def sql_fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def sql_key(x: str) -> str:
    accents = f"translate(strip_accents({x}), '²³¹ºª', '231oa')"
    return sql_fold(sql_space(accents))


def sql_title(x: str) -> str:
    word = "CASE WHEN w = upper(w) AND w <> lower(w) THEN upper(w[1]) || lower(w[2:]) ELSE w END"
    return f"array_to_string(list_transform(string_split({sql_space(x)}, ' '), lambda w: {word}), ' ')"


def sql_decimal(x: str) -> str:
    token = rf"regexp_extract({sql_space(x)}, '[-+]?\d[\d.,]*')"
    return rf"""TRY_CAST(CASE
      WHEN contains({token}, ',') THEN replace(replace({token}, '.', ''), ',', '.')
      WHEN regexp_matches({token}, '^[^.]+(\.[^.]{{3}})+$') THEN replace({token}, '.', '')
      ELSE {token} END AS DECIMAL(28,10))"""


def sql_money(x: str) -> str:
    return f"CAST(round_even({sql_decimal(x)}, 2) AS DECIMAL(18,2))"


def sql_br(x: str, places: int = 2) -> str:
    """A number written the Brazilian way."""
    return f"translate(format('{{:,.{places}f}}', CAST({x} AS DOUBLE)), ',.', '.,')"


def sql_untracked(x: str) -> str:
    """Tracking parameters cut out of an address whose query needs no escapes."""
    names = "utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid|msclkid"
    cut = f"regexp_replace({x}, '([?&])(?:(?:{names})=[^&#]*&?)+', '\\1', 'g')"
    return f"regexp_replace({cut}, '[?&]+(#|$)', '\\1')"
