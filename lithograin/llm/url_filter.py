"""URL filter: weighted vocabulary matched by an Aho-Corasick automaton.

A URL is rejected on one strict term, or on ``soft_limit`` distinct soft terms. A
term counts only between boundaries: no ASCII letter or digit may touch it.
Host/path rules go before the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One of these terms rejects a URL.
STRICT_TERMS = ("casino", "porn", "xxx", "pills", "viagra", "cialis", "escort", "malware", "phishing", "warez")
#: Two different terms of these reject a URL.
SOFT_TERMS = ("adult", "ads", "bet", "bets", "bonus", "cheap", "click", "coupon", "dating", "deal", "free", "jackpot", "loan", "lottery", "poker", "promo", "sex", "slots", "spam", "track", "tracker", "win", "winner")
#: Fixed values: (host, path prefix, verdict); the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@dataclass(frozen=True)
class UrlPolicy:
    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_limit: int = 2
    rules: tuple[tuple[str, str, str], ...] = RULES
    by_host: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for host, path, verdict in self.rules:
            self.by_host.setdefault(host, []).append((path, verdict))


#: Terms of a policy that every task holds.
MOST_TERMS = 2_000_000


def policy_of(terms: DataFrame, most_terms: int = MOST_TERMS, **options) -> UrlPolicy:
    """A policy from a table of term and strict (boolean), such as a published word list. A-Z are lower-cased; null and empty
    terms are left out, and a term that is listed as both is strict. More than ``most_terms`` of them are an error."""
    rows = terms.select("term", "strict").where(F.coalesce(F.octet_length("term"), F.lit(0)) > 0).groupBy("term").agg(F.max(F.coalesce("strict", F.lit(False))).alias("strict"))
    found = rows.limit(most_terms + 1).collect()
    if len(found) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    strict = {_lower(r["term"]) for r in found if r["strict"]}
    return UrlPolicy(strict=tuple(sorted(strict)), soft=tuple(sorted({_lower(r["term"]) for r in found} - strict)), **options)


def _lower(text: str) -> str:
    return text.translate(_UPPER)


_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``. User info and port stay in the host."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    return (_lower(rest), "") if cut < 0 else (_lower(rest[:cut]), rest[cut:])


def rule_for(host: str, path: str, policy: UrlPolicy) -> tuple[str | None, str | None]:
    """The longest rule (host and path together) for the host or a parent of it."""
    best: tuple[int, str | None, str | None] = (-1, None, None)
    parent = host
    while parent:
        for prefix, verdict in policy.by_host.get(parent, ()):
            if path.startswith(prefix) and (size := len(parent) + len(prefix)) > best[0]:
                best = (size, parent + prefix, verdict)
        _, found, parent = parent.partition(".")
        if not found:
            break
    return best[1], best[2]


def automaton(policy: UrlPolicy) -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for term in policy.soft:
        trie.add_word(term, (term, False))
    for term in policy.strict:
        trie.add_word(term, (term, True))
    trie.make_automaton()
    return trie


def _word_char(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def vocabulary_hits(url: str, trie: ahocorasick.Automaton) -> tuple[int, set[str], set[str]]:
    """Number of bounded hits, distinct strict terms, distinct soft terms."""
    hits, strict, soft = 0, set(), set()
    for end, (term, is_strict) in trie.iter(url):
        if _word_char(url, end + 1) or _word_char(url, end - len(term)):
            continue
        hits += 1
        (strict if is_strict else soft).add(term)
    return hits, strict, soft


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", policy: UrlPolicy | None = None) -> DataFrame:
    """key, host, path, rule, verdict, n_hits, n_strict, n_soft, terms: a row per input row.

    A null or empty URL, or one without ``://``, has an empty host and path; its text is
    still matched against the vocabulary. Repeated rows are judged alike; other columns
    are ignored. Runs in one pass without a shuffle, an Arrow batch at a time.
    """
    shared = pages.sparkSession.sparkContext.broadcast(policy or UrlPolicy())
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, n_hits int, n_strict int, n_soft int, terms string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policy = shared.value
        trie = automaton(policy)
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(1).to_pylist():
                host, path = split_url(value)
                rule, verdict = rule_for(host, path, policy)
                hits, strict, soft = vocabulary_hits(_lower(value or ""), trie)
                if verdict is None:
                    verdict = "block" if strict or len(soft) >= policy.soft_limit else "allow"
                out.append((host, path, rule, verdict, hits, len(strict), len(soft), ",".join(sorted(strict | soft))))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, "host", "path", "rule", "verdict", "n_hits", "n_strict", "n_soft", "terms"])

    return pages.select(key, url).mapInArrow(judge, schema)
