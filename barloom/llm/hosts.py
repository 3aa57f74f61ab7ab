"""URL verdicts: rules first, else trust and distrust that spread over links between hosts. SQL functions only."""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Share that follows links, most rounds, and the change at which rounds end.
DAMPING, ROUNDS, SETTLED = 0.85, 40, 1e-6
#: A host is blocked if its distrust exceeds its trust by this part of what a wholly blocked host gives itself.
THRESHOLD = 0.5


def _lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case (A-Z); empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    name = verdict = F.when(F.lit(False), F.lit(""))
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = name.when(fits, r.name), verdict.when(fits, r.verdict)
    return name, verdict


def judged_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (null without a rule) of every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): n pages of src link to dst. Links to the own host, relative ones among them, do not count."""
    url = F.coalesce(F.col("url"), F.lit(""))
    links = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    to = F.array_distinct(F.transform(links, lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x))))
    rows = pages.select(host_of(url).alias("src"), F.explode(to).alias("dst"))
    return rows.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad: shares from 0 to 1) and links (src, dst, n).

    Trust is personalised PageRank: a host passes it on to those it links to. Distrust runs against the links: a host
    passes it to those that link to it. Both are divided by what a seed of share 1 gives itself, so a host
    without links keeps the shares of its seed. Each round is joins and sums of a table written to the shared folder.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total_in"))
    edges = links.join(out, "src").join(into, "dst")
    edges = written(edges.select("src", "dst", (F.col("n") / F.col("total_out")).alias("forth"), (F.col("n") / F.col("total_in")).alias("back")), "host-links")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    seeds = ends.join(seeds, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad"))
    seeds = written(seeds, "host-seeds")
    state = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    if edges.isEmpty():
        return state
    for _ in range(rounds):
        forth = edges.join(state, edges["src"] == state["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(state, edges["dst"] == state["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        got = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = seeds.join(got, "host", "left").select(
            "host",
            (F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        new = written(new, "host-scores")
        was = state.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        change = new.join(was, "host").agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))))).first()[0]
        state = new
        if change is None or change < SETTLED:
            break
    return state


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: every page.

    Pages that a rule fits have its verdict. The share of a host's pages that rules allow or block makes it a seed of
    trust or distrust; both spread over the links of its pages (see ``host_scores``). Pages without a rule are blocked
    if the distrust of their host exceeds its trust by ``threshold`` or more, else allowed. A null url, or one without
    ``://``, has an empty host and path, no links and is allowed; a null html has no links. Repeated rows count as
    pages of their own. Other columns are not looked at.
    """
    urls = judged_urls(pages, rules)
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    seeds = urls.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    scores = host_scores(seeds, host_links(pages))
    rows = urls.join(scores, "host", "left")
    spread = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", spread).alias("verdict"), "trust", "distrust")
