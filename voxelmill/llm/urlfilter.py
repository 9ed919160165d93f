"""URL filter: host and path rules, and a weighted vocabulary found by Aho-Corasick.

A url is first held against rules (action, host, path): a rule fits its host and all subdomains where the url's path
starts with the rule's; the longest rule wins. Urls without a rule are judged by terms: an automaton finds all terms in
one pass over the lower-cased url, a hit counts only between characters that are no ASCII letters or digits, and a url is
blocked by one strict term, or by ``min_soft`` or more distinct soft terms whose weights sum to ``limit`` or more. A soft term and its plural
are one term. With the given weights two strong terms block, or a strong and three weak ones, or six weak ones.

Null urls and urls without ``://`` have an empty host and path, fit no rule and, but for terms, are allowed. Rows are
judged one by one: no shuffle. Input columns with the names of outputs are replaced. Rules are a parameter that goes
into the plan, so a short list; ties in length go to the first in order of host and path.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the query's contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
STRICT = """
bdsm bestiality blowjob botnet camgirl camsex casino cialis creampie cumshot darknet deepthroat dildo escort gangbang handjob hentai
incest keygen keylogger levitra malware milf nudes orgasm phishing porn porno ransomware rootkit serialz sex sexcam sexting shemale
slut spyware striptease threesome torrent tramadol upskirt viagra voyeur warez whore xanax xxx
""".split()
STRONG = """
adult airdrop anabolic baccarat bet bingo blackjack bonus bookmaker botox cheap cheat click clickbait counterfeit crack dating debt
detox erotic exploit fetish forex free gambling giveaway hack hacker hookup jackpot leaked loan lottery miracle naked nude nulled
payday pharmacy pill piracy pirate poker ponzi prize proxy replica roulette scam sexy slot spam steroid stripper sweepstake swinger
trojan wager webcam weightloss win winner
""".split()
WEAK = """
ads affiliate amateur babe buy cam cash casual chat coupon crypto date deal diet discount download earn flirt game girl guaranteed
hot income instant invest loot lucky money offer online order popunder popup price profit promo quick rich sale serial single
stream teen track tracker unlimited vip voucher
""".split()
SOFT = {**dict.fromkeys(WEAK, 1), **dict.fromkeys(STRONG, 3)}
MIN_SOFT, LIMIT = 2, 6
_WORDY = frozenset(string.ascii_lowercase + string.digits)


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_column(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, or nulls."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def forms(term: str) -> list[str]:
    """A soft term and its plural."""
    if term[-1:] == "y" and term[-2:-1] not in ("", *"aeiou"):
        return [term, term[:-1] + "ies"]
    return [term, term + ("es" if term.endswith(("s", "x", "z", "ch", "sh")) else "s")]


def automaton(strict: list[str], soft: dict[str, int]):
    """Finds forms as (length, term, weight); a strict term has no weight. A form of two soft terms is that of the heavier."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in sorted(soft.items(), key=lambda x: (x[1], x[0])):
        for form in forms(term):
            a.add_word(form, (len(form), term, weight))
    for term in strict:
        a.add_word(term, (len(term), term, None))
    a.make_automaton()
    return a


def term_hits(a, url: str) -> tuple[int, int, int, int]:
    """Strict hits, soft hits, distinct soft terms and their weight in a lower-cased url."""
    strict = hits = 0
    distinct = {}
    for end, (length, term, weight) in a.iter(url) if len(a) else ():
        start = end - length + 1
        if (start and url[start - 1] in _WORDY) or (end + 1 < len(url) and url[end + 1] in _WORDY):
            continue
        if weight is None:
            strict += 1
        else:
            hits += 1
            distinct[term] = weight
    return strict, hits, len(distinct), sum(distinct.values())


def hits_column(url: Column, strict: list[str], soft: dict[str, int]) -> Column:
    state: dict = {}

    @F.arrow_udf("struct<strict:int,soft:int,distinct_soft:int,weight:long>")
    def url_terms(urls: pa.Array) -> pa.Array:
        if "a" not in state:
            state["a"] = automaton(strict, soft)
        found = [term_hits(state["a"], u or "") for u in urls.to_pylist()]
        columns = list(zip(*found)) or [()] * 4
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["strict", "soft", "distinct_soft", "weight"])

    return url_terms(_lower(url))


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, strict: list[str] | None = None, soft: dict[str, int] | None = None, min_soft: int = MIN_SOFT, limit: int = LIMIT) -> DataFrame:
    """``df`` with ``host, path, rule, strict_hits, soft_hits`` (distinct terms), ``soft_weight, verdict``. ``soft`` gives each term's weight."""
    rules, strict, soft = RULES if rules is None else rules, STRICT if strict is None else strict, SOFT if soft is None else soft
    out = df.withColumn("__hits", hits_column(F.col(url), strict, soft)).withColumn("__host", host_column(F.col(url))).withColumn("__path", path_column(F.col(url)))
    name, action = rule_columns(F.col("__host"), F.col("__path"), rules)
    bad = (F.col("__hits.strict") >= 1) | (F.col("__hits.distinct_soft") >= min_soft) & (F.col("__hits.weight") >= limit)
    made = {"host": F.col("__host"), "path": F.col("__path"), "rule": name, "strict_hits": F.col("__hits.strict"), "soft_hits": F.col("__hits.distinct_soft"), "soft_weight": F.col("__hits.weight"), "verdict": F.coalesce(action, F.when(bad, "block").otherwise("allow"))}
    return out.withColumns(made).drop("__hits", "__host", "__path")


def oracle_sql(min_soft: int = MIN_SOFT, limit: int = LIMIT) -> str:
    """The query's rows in DuckDB SQL. Its terms are letters and digits alone, so hits between boundaries are whole runs of such characters."""
    low = f"translate(coalesce(url, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    ordered = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ordered)
    act = " ".join(f"when {fits(h, p)} then '{a}'" for a, h, p in ordered)
    heavier = {f: (t, w) for t, w in sorted(SOFT.items(), key=lambda x: (x[1], x[0])) for f in forms(t)}
    values = ", ".join(f"('{f}', '{t}', {w})" for f, (t, w) in [*((f, x) for f, x in heavier.items() if f not in STRICT), *((t, (t, 0)) for t in STRICT)])
    return (
        f"with terms(form, term, weight) as (values {values}),"
        f" p as (select row_number() over () as n, page_id, {low} as u, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host,"
        " coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),"
        " found as (select distinct n, term, weight from (select n, unnest(regexp_extract_all(u, '[a-z0-9]+')) as form from p) join terms using (form)),"
        f" bad as (select n from found group by n having min(weight) = 0 or count(*) >= {min_soft} and sum(weight) >= {limit})"
        f" select page_id, host, path, case {rule} end as rule, case {act} when n in (select n from bad) then 'block' else 'allow' end as verdict from p"
    )
