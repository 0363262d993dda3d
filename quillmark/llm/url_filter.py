"""URL filters: host/path rules, then a weighted vocabulary of terms."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict): the longest rule that fits decides.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: One of these terms rejects.
STRICT_TERMS = ("porn", "xxx", "hentai", "escort", "viagra", "cialis", "warez", "casino", "sportsbet", "camgirl", "phishing", "keygen")
#: Different ones of these reject by the sum of their weights: words of other
#: pages too weigh 2, words that seldom stand in them 3.
SOFT_TERMS = {
    **dict.fromkeys(("bet", "bonus", "cheap", "click", "deal", "download", "farm", "free", "loan", "promo", "win"), 2),
    **dict.fromkeys(("adult", "crack", "dating", "gamble", "lottery", "nude", "payday", "pills", "poker", "replica", "sex", "slots", "spam", "torrent", "xtube"), 3),
}
#: Two terms of weight 2 stay below it.
SOFT_LIMIT = 5


class TermCounter:
    """Counts strict and soft terms of a URL.

    A term counts where no letter or digit touches it on either side; the
    automaton finds all terms in one pass over the text.
    """

    def __init__(self, strict=STRICT_TERMS, soft=SOFT_TERMS):
        import ahocorasick

        self.weights = dict(soft)
        self.found = ahocorasick.Automaton()
        for term in soft:
            self.found.add_word(term, (term, False))
        for term in strict:
            self.found.add_word(term, (term, True))
        self.found.make_automaton()

    def __call__(self, text: str) -> tuple[int, int, int]:
        """Occurrences of strict terms, different soft terms and their weights' sum."""
        strict, soft = 0, set()
        for end, (term, hard) in self.found.iter(text):
            before, after = text[end - len(term) : end - len(term) + 1] if end >= len(term) else "", text[end + 1 : end + 2]
            if before.isalnum() or after.isalnum():
                continue
            if hard:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft), sum(self.weights[t] for t in soft)


_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_AZ), _PATH.match(url, host.end())[0]


class RuleTable:
    """Rules by host; a host's lookups are its own labels' suffixes."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((host + path, path, verdict))

    def __call__(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, at = (None, None), 0
        while host:
            for rule, start, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_limit: int = SOFT_LIMIT, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight of every row.

    The longest fitting rule decides, of equally long ones that of the longer
    host; without one a URL is blocked on one strict term, or on different soft
    terms whose weights reach ``soft_limit``, in its lowered text.  A
    null URL, and one without ``://``, has an empty host and path and fits no
    rule; its terms count all the same (a null has none).  Rows stand for
    themselves, so repeated rows and null ids come out as they went in; columns
    besides the id and the URL are not read, and an empty table gives no rows.
    """

    def run(batches):
        table, count = RuleTable(rules), TermCounter(strict, soft)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = table(host, path)
                hard, mild, weight = count((url or "").translate(_AZ))
                out.append((host, path, rule, verdict or ("block" if hard or weight >= soft_limit else "allow"), hard, mild, weight))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule, verdict and term counts."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle_sql(soft_limit: int = SOFT_LIMIT) -> str:
    """The same in DuckDB's SQL, over ``pages``."""

    def hits(term: str) -> str:
        return f"len(regexp_extract_all(concat(chr(1), regexp_replace(u, '{term}', chr(2) || '{term}' || chr(2), 'g'), chr(1)), '[^\\p{{L}}\\p{{N}}]\\x02{term}\\x02[^\\p{{L}}\\p{{N}}]'))"

    rules = " ".join(
        f"UNION ALL SELECT '{host}{path}' AS r, '{host}' AS rh, '{path}' AS rp, '{verdict}' AS rv" for host, path, verdict in RULES
    ).removeprefix("UNION ALL ")
    # a URL has no two overlapping occurrences of one term that both stand free
    strict = " + ".join(hits(t) for t in STRICT_TERMS)
    soft = " + ".join(f"CAST({hits(t)} > 0 AS BIGINT)" for t in SOFT_TERMS)
    weight = " + ".join(f"{w} * CAST({hits(t)} > 0 AS BIGINT)" for t, w in SOFT_TERMS.items())
    return f"""
WITH rules AS ({rules}),
cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         row_number() OVER () AS n
  FROM pages),
parts AS (
  SELECT n, page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
best AS (
  SELECT n, max_by(r, 1000 * length(r) + length(rh)) AS rule, max_by(rv, 1000 * length(r) + length(rh)) AS rv
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY n),
counted AS (
  SELECT n, CAST({strict} AS BIGINT) AS strict_hits, CAST({soft} AS BIGINT) AS soft_hits, CAST({weight} AS BIGINT) AS soft_weight FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(rv, CASE WHEN strict_hits > 0 OR soft_weight >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits, soft_weight
FROM parts JOIN counted USING (n) LEFT JOIN best USING (n)"""
