"""URL filter: ordered allow/block rules, then a weighted vocabulary.

The vocabulary is a table of terms with weights, a parameter; the default holds terms in
English, German, French and Spanish. It is matched with one Aho-Corasick pass per URL. A hit
counts only between boundaries (no ASCII letter or digit on either side). The weights of a
URL's distinct terms add up; at ``LIMIT`` the URL is rejected. Strict terms weigh as much, so
one rejects alone; soft terms weigh 1 or 2, so it takes several distinct ones.

Percent-encoded letters and digits are decoded first (they mean the same in a URL), one
character after the other.

Rules are ``host/path`` strings. A rule fits its host and all its subdomains if the
URL's path starts with the rule's path; the longest fitting rule wins, a block rule
before an allow rule of equal length.

Defined results: a null URL, or one without ``://``, has empty host and path, fits
no rule and is judged by the vocabulary alone (a null URL has no hits: allow); very long
URLs are read whole, in one pass. Repeated rows are judged alike, an empty table gives an
empty result, and input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 3
# The default vocabulary, lower case.
STRICT_TERMS = (
    # English
    "camgirl", "camgirls", "casino", "casinos", "cialis", "erotic", "erotica", "hentai", "hookup", "hookups",
    "milf", "porn", "porno", "pornography", "viagra", "warez", "xxx",
    # German
    "erotik", "pornos", "sexkontakte", "spielbank", "spielcasino",
    # French
    "erotique", "pornographie", "rencontresexe",
    # Spanish
    "erotico", "pornografia", "putas",
)
#: Soft terms that weigh 2.
SUSPECT_TERMS = (
    # English
    "adult", "adults", "adware", "baccarat", "betting", "bookmaker", "crack", "cracked", "doorway", "escort", "escorts", "gamble", "gambling", "jackpot", "keygen", "lottery", "malware", "naked", "nude", "nudes",
    "payday", "phishing", "pills", "pirate", "poker", "roulette", "sex", "sexy", "slots", "spam", "spyware", "torrent", "torrents", "webcam", "webcams",
    # German
    "gewinnspiel", "nackt", "wetten",
    # French
    "rencontres",
    # Spanish
    "apuesta", "apuestas", "desnuda", "desnudas",
)
#: Soft terms that weigh 1.
SOFT_TERMS = (
    # English
    "ads", "affiliate", "affiliates", "bet", "bets", "bingo", "bonus", "cheap", "cheats", "clickbait", "coupon", "coupons", "crypto", "dating", "discount",
    "farm", "followers", "forex", "free", "giveaway", "hot", "loan", "loans", "lotto", "pharmacy", "popup", "prize", "prizes", "promo", "replica", "seo",
    "singles", "slot", "track", "tracker", "voucher", "win", "winner", "winners",
    # German
    "billig", "gewinn", "gewinnen", "gratis", "gutschein", "kostenlos", "kredit", "kredite", "rabatt",
    # French
    "cadeau", "gagner", "gratuit", "gratuits", "rencontre", "remise", "soldes",
    # Spanish
    "barato", "baratos", "citas", "descuento", "descuentos", "ganar", "prestamo", "prestamos", "sorteo",
)
VOCABULARY = {t: LIMIT for t in STRICT_TERMS} | {t: 2 for t in SUSPECT_TERMS} | {t: 1 for t in SOFT_TERMS}
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.when(has, F.regexp_extract(url, parts, 1)).otherwise("")
    path = F.when(has, F.regexp_extract(url, parts, 2)).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The winning rule and its verdict, null where none fits. Rules go longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


#: Codes of ASCII letters and digits, and the lower-case character each stands for.
ENCODED = tuple((f"%{ord(c):02x}", c.lower()) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


_ESCAPE = re.compile("%[0-9a-f]{2}")


def plain_url(url: str) -> str:
    """A URL with A-Z lower-cased, percent-encoded letters and digits decoded, and other escapes as a boundary."""
    low = url.translate(_LOWER)
    if "%" in low:
        for code, c in ENCODED:
            low = low.replace(code, c)
        low = _ESCAPE.sub(" ", low)
    return low


def automaton(vocabulary: Mapping[str, int], limit: int) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        built.add_word(term, (term, weight, weight >= limit))
    built.make_automaton()
    return built


def _plain(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


def distinct_hits(built: ahocorasick.Automaton, url: str) -> tuple[int, int, int]:
    """Numbers of distinct strict and soft terms of a URL, between boundaries, and the sum of their weights."""
    low = plain_url(url)
    found = set()
    for end, (term, weight, strict) in built.iter(low):
        start = end - len(term) + 1
        if (start == 0 or not _plain(low[start - 1])) and (end + 1 == len(low) or not _plain(low[end + 1])):
            found.add((term, weight, strict))
    strict = sum(s for _, _, s in found)
    return strict, len(found) - strict, sum(w for _, w, _ in found)


def judge_urls(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    vocabulary: Mapping[str, int] = VOCABULARY,
    limit: int = LIMIT,
) -> DataFrame:
    """``df`` with host, path, strict_hits, soft_hits, weight, rule and verdict. No shuffle.

    The rules become one expression and the vocabulary goes to the tasks whole: both are
    hand-kept lists.
    """
    vocabulary = dict(vocabulary)

    @F.pandas_udf("strict int, soft int, weight int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        built = automaton(vocabulary, limit)
        for urls in batches:
            found = [distinct_hits(built, u) if u else (0, 0, 0) for u in urls]
            yield pd.DataFrame(found, columns=["strict", "soft", "weight"], dtype="int32")

    host, path = split_url(F.col(url))
    out = df.withColumns({"host": host, "path": path, "_hits": hits(F.col(url))})
    rule, told = rule_columns(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("_hits.weight") >= limit, "block").otherwise("allow")
    return out.withColumns(
        {"strict_hits": F.col("_hits.strict"), "soft_hits": F.col("_hits.soft"), "weight": F.col("_hits.weight"), "rule": rule, "verdict": F.coalesce(told, judged)}
    ).drop("_hits")
