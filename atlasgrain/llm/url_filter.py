"""URL filters: logistic regression on hashed character n-grams of host and path, besides a rule list.

Training is a few hundred gradient steps on the driver over the small labelled table ``LABELLED`` (a constant of this
module). The weights, rounded to integers of 1e-6, become one constant array of ``BUCKETS`` entries; scoring is a single
projection of DataFrame functions. An n-gram's bucket comes from a polynomial over its code points, which any SQL
engine can repeat, and integer sums do not depend on their order.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and the model's verdict on two
empty strings; repeated rows each get a verdict; an empty table gives an empty result; of two rules of one length both would
be the same text; a score of exactly zero allows; other columns stay, whatever their names, but for columns named host,
path, rule, score or verdict, which the results replace. URLs are read whole, whatever their length.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read

BUCKETS = 2048
GRAM = 4
SCALE = 1_000_000
#: verdict, host, path; longest text wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

_BAD = """cheap-pills.example.com/en/1 www.cheap-pills.example.net/ spam-farm.example.org/en/72 blog.spam-farm.example.com/fr/9.html
win-casino.example.org/play casino-bonus.example.net/en/5 free-money.example.org/claim?x=1 viagra-shop.example.com/buy cheap-meds.example.org/en/33
poker-online.example.net/slots xxx-videos.example.com/hot adult-cams.example.org/live best-seo-links.example.net/en/4 payday-loan.example.org/apply
crypto-doubler.example.com/en/8 replica-watches.example.net/sale link-farm.example.org/de/1 click-bait.example.com/top10 hot-deals-pills.example.net/es/3
spam-farm.example.net/es/455 cheap-pills.example.org/fr/12/ casino-spam.example.com/win lottery-winner.example.net/prize phish-login.example.org/verify
malware-download.example.net/free-exe warez-crack.example.org/keygen torrent-porn.example.com/xxx spam-blog.example.org/en/71 pills-online.example.org/order""".split()
_GOOD = """www.thering.example.com/en/12.html blog.thernd.example.net/de/612 m.ththth.example.org/en/25 news.example.org/world/2020 docs.library.example.org/guide
university.example.org/research/papers www.museum.example.net/visit therha.example.com/en/676 ththly.example.net/en/777 thther.example.org/fr/414
www.thertion.example.org/es/978 weather.example.net/forecast wiki.example.org/article/history city-council.example.org/minutes recipes.example.com/soup
blog.gardening.example.org/roses open-source.example.net/project/readme www.tionsh.example.net/de/533 health.example.org/advice school.example.net/classes
ththen.example.com/en/148.html theren.example.net/en/455 ththwh.example.org/en/471 science.example.com/physics/quantum travel.example.org/alps
m.therou.example.org/en/474.html www.ththed.example.org/en/453 blog.ththan.example.net/en/960 books.example.org/authors/list music.example.net/concerts""".split()


def _split(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, slash + path.partition("?")[0].partition("#")[0]


#: host, path, 1 for a page to block.
LABELLED: list[tuple[str, str, int]] = [(*_split(u), 1) for u in _BAD] + [(*_split(u), 0) for u in _GOOD]


def _bucket(gram: str) -> int:
    x = 0
    for c in gram:
        x = (x * 131 + ord(c)) % 1_000_003
    return x % BUCKETS


def _grams(host: str, path: str) -> list[int]:
    out = []
    for mark, part in (("^", host), ("/", path)):
        s = mark + part + "$"
        out += [_bucket(s[i : i + GRAM]) for i in range(len(s) - GRAM + 1)]
    return out


@cache
def train(rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> tuple[tuple[int, ...], int]:
    """Integer weights by bucket, and the bias, from batch gradient descent on ``LABELLED``."""
    rows = [(g, y) for h, p, y in LABELLED if (g := _grams(h, p))]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        grad, total = dict.fromkeys({b for g, _ in rows for b in g}, 0.0), 0.0
        for g, y in rows:
            z = bias + sum(w[b] for b in g) / math.sqrt(len(g))
            e = 1 / (1 + math.exp(-z)) - y
            total += e
            for b in g:
                grad[b] += e / math.sqrt(len(g))
        for b, v in grad.items():
            w[b] -= rate * (v / len(rows) * 4 + decay * w[b])
        bias -= rate * total / len(rows)
    return tuple(round(x * SCALE) for x in w), round(bias * SCALE)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _gram_sum(part: Column, mark: str, weights: Column) -> tuple[Column, Column]:
    """Sum of the weights of a part's n-grams, and their number."""
    s = F.concat(F.lit(mark), part, F.lit("$"))
    n = F.greatest(F.length(s) - (GRAM - 1), F.lit(0))
    codes = F.transform(F.array_remove(F.split(s, ""), ""), lambda c: F.ascii(c).cast("long"))

    def bucket(c: Column, i: Column) -> Column:
        x = F.lit(0).cast("long")
        for k in range(GRAM):
            x = (x * 131 + F.get(c, i + k)) % 1_000_003
        return (x % BUCKETS).cast("int")

    total = F.transform(F.array(codes), lambda c: F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, i: a + F.get(weights, bucket(c, i))))[0]
    return total, n


def judge_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (logit, double) and verdict, in place of any columns of these names."""
    weights, bias = train()
    table = F.lit(list(weights)).cast("array<bigint>")
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    # all work is on one struct column, whose name no input column has
    w = fresh(pages, "work")
    host, path = split_url(F.col(f"`{url}`"))
    out = pages.select(*[F.col(f"`{c}`") for c in keep], F.struct(host.alias("host"), path.alias("path")).alias(w))
    h, p = F.col(f"{w}.host"), F.col(f"{w}.path")
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((h == of) | h.endswith("." + of)) & p.startswith(start)
        rule, says = F.when(fits, of + start).otherwise(rule), F.when(fits, kind).otherwise(says)
    (a, m), (b, n) = _gram_sum(h, "^", table), _gram_sum(p, "/", table)
    out = out.withColumn(w, F.struct(h.alias("host"), p.alias("path"), rule.alias("rule"), says.alias("says"), (a + b).alias("sum"), (m + n).alias("n")))
    score = (F.col(f"{w}.sum") / F.sqrt(F.greatest(F.col(f"{w}.n"), F.lit(1)).cast("double")) + bias) / SCALE
    out = out.withColumn(w, F.struct(*[F.col(f"{w}.{c}").alias(c) for c in ("host", "path", "rule", "says")], score.alias("score")))
    verdict = F.coalesce(F.col(f"{w}.says"), F.when(F.col(f"{w}.score") > 0, "block").otherwise("allow"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"{w}.{c}").alias(c) for c in ("host", "path", "rule", "score")], verdict.alias("verdict"))


def oracle() -> str:
    weights, bias = train()
    poly = "0"
    for k in range(GRAM):
        poly = f"(({poly}) * 131 + unicode(s[i + {k}])) % 1000003"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(k, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for k, h, p in ordered]
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{upper.lower()}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT rid, s, unnest(range(1, length(s) - {GRAM} + 2)) AS i
      FROM (SELECT rid, '^' || host || '$' AS s FROM h UNION ALL SELECT rid, '/' || path || '$' AS s FROM h)),
b AS (SELECT rid, ((({poly}) % {BUCKETS}) + 1)::INT AS bucket FROM g),
m AS (SELECT idx::INT AS bucket, w FROM (SELECT unnest(range(1, {BUCKETS + 1})) AS idx, unnest([{", ".join(map(str, weights))}]) AS w)),
z AS (SELECT rid, sum(w)::DOUBLE AS total, count(*)::DOUBLE AS n FROM b JOIN m USING (bucket) GROUP BY rid),
r AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{t}'" for _, t, c in fits)} END AS rule,
        CASE {" ".join(f"WHEN {c} THEN '{k}'" for k, _, c in fits)} END AS says,
        (coalesce(total, 0) / sqrt(greatest(coalesce(n, 0), 1)) + {bias}) / {SCALE} AS score FROM h LEFT JOIN z USING (rid))
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
