"""URL filters: rules first, then trust and distrust spread over the host graph. DataFrame operations only.

A url's host and path are matched against rules (a host with all its subdomains, and a path prefix); the
longest rule decides. Hosts of pages that rules allow are seeds of trust, hosts of pages that rules block
are seeds of distrust, each weighed by its pages. Trust flows along links (personalised PageRank with
restarts at the trusted seeds), distrust flows against them, from a blocked host to hosts that link to
it. Both are counted in pages, so each host has its own threshold: it is blocked if its distrust exceeds
its trust by `share` of its pages (times the restart probability, at which seeds keep their pages) or more.
Pages without a rule get their host's verdict, allow where nothing is known.

Links are the absolute and protocol-relative href targets of a page's html; relative ones stay on the host
and count for nothing. Edges are summed by pair of hosts before anything is joined, ranks are pre-aggregated,
and rounds go on until ranks settle, cut by tables in the shared folder. Null urls and urls without `://` have an empty host and
path, match no rule and are allowed. Null html has no links; very long html is read whole. Repeated rows are
judged alike; of rules of equal length the one given last decides. Columns of pages called host, path, rule or
verdict don't matter. Without pages or seeds nothing is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import ASCII_LOWER, ASCII_UPPER, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Settings:
    damping: float = 0.85
    #: Rounds between two looks at how much the ranks change; the SQL has as many in all.
    rounds: int = 8
    tolerance: float = 1e-7
    share: float = 0.5
    #: Tables of so many hosts at most are broadcast; larger ones are joined by a salted shuffle.
    broadcast_rows: int = 500_000
    salts: int = 32


LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s<>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(rest) + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, or null. One expression over all rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the last one wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict)."""
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    return p.withColumn("_r", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: links between different hosts, summed."""
    src, _ = host_path(F.col("url"))
    # only pages with a link that may leave the host are read further
    linked = pages.select(src.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("t"))
    linked = linked.select("src", F.translate("t", ASCII_UPPER, ASCII_LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def spread(seeds: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """seeds (host, trust, distrust: numbers of pages) -> host, trust, distrust, settled: rounds go on until
    the ranks change by less than `tolerance` of all seeds. A round keeps at most `damping` of the change
    before it, so this ends."""
    edges = stored(edges, "host-edges")
    start = seeds.select("host", ((1 - s.damping) * F.col("trust")).alias("trust"), ((1 - s.damping) * F.col("distrust")).alias("distrust"))
    if edges.isEmpty():
        return start
    out = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    shares = edges.join(out, "src").join(into, "dst")
    # trust flows along links, distrust against them
    forth = shares.select(F.col("src").alias("host"), F.lit(1).alias("trusting"), F.col("dst").alias("to"), (s.damping * F.col("w") / F.col("out_w")).alias("f"))
    back = shares.select(F.col("dst").alias("host"), F.lit(0).alias("trusting"), F.col("src").alias("to"), (s.damping * F.col("w") / F.col("in_w")).alias("f"))
    flow = forth.union(back)
    # how many edges a rank flows along: hubs' edges stay where they are, and their ranks are broadcast
    degree = flow.groupBy("host", "trusting").agg(F.count("*").alias("degree"))
    flow, degree = stored(flow, "host-shares"), stored(degree, "host-degrees")
    n_flow, n_hosts = flow.count(), degree.count()
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("trusting"), F.col("trust").alias("rank")), F.struct(F.lit(0).alias("trusting"), F.col("distrust").alias("rank"))))
    start = stored(start.select("host", kinds.alias("k")).select("host", "k.*").where("rank > 0"), "host-seeds")
    n_ranks = n_hosts + start.count()
    least = s.tolerance * (start.agg(F.sum("rank")).first()[0] or 0.0)
    state, change = start, None
    small = n_ranks <= s.broadcast_rows
    # hubs don't change from round to round: which ranks are looked up where is settled before
    heavy = stored(degree.where(F.col("degree") * 1000 > n_flow).select("host", "trusting"), "host-hubs")
    flow_parts = [flow] if small else [flow.join(F.broadcast(heavy), ["host", "trusting"], how) for how in ("left_semi", "left_anti")]

    def moved_from(ranks: DataFrame) -> DataFrame:
        """What flows from hosts with these ranks: one use of the ranks for each part of the flow."""
        if small:
            return flow.join(F.broadcast(ranks), ["host", "trusting"])
        hubs = F.broadcast(ranks.join(F.broadcast(heavy), ["host", "trusting"], "left_semi"))
        return flow_parts[0].join(hubs, ["host", "trusting"]).unionByName(flow_parts[1].join(ranks, ["host", "trusting"]))

    while change is None or change > least:
        before = state
        for k in range(s.rounds):
            moved = moved_from(state).select(F.col("to").alias("host"), "trusting", (F.col("rank") * F.col("f")).alias("rank"))
            state = start.union(moved).groupBy("host", "trusting").agg(F.sum("rank").alias("rank"))
            if not small or k == s.rounds - 1:  # rounds with broadcasts fit one plan, others are cut each time
                state = stored(state, "host-ranks")
        both = state.union(before.withColumn("rank", -F.col("rank"))).groupBy("host", "trusting").agg(F.sum("rank").alias("d"))
        change = both.agg(F.sum(F.abs("d"))).first()[0] or 0.0
    return state.groupBy("host").agg(F.sum(F.when(F.col("trusting") == 1, F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("trusting") == 0, F.col("rank")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], s: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    ruled = stored(by_rules(pages, rules), "ruled-pages")
    hosts = stored(ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("trust"), F.count_if(F.col("ruled") == "block").cast("double").alias("distrust"), F.count("*").alias("pages")), "hosts")
    ranks = spread(hosts.where("trust > 0 or distrust > 0").select("host", "trust", "distrust"), host_edges(pages), s)
    over = F.round(F.col("distrust") - F.col("trust"), 9) >= (1 - s.damping) * s.share * F.col("pages")
    blocked = stored(ranks.join(hosts.select("host", "pages"), "host").where(over).select("host", F.lit("block").alias("spread")), "blocked-hosts")
    if blocked.count() <= s.broadcast_rows:
        joined = ruled.join(F.broadcast(blocked), "host", "left")
    else:
        salted = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(s.salts)))
        spread_out = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
        joined = salted.join(spread_out, ["host", "salt"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def oracle(rules: list[Rule], s: Settings = Settings()) -> str:
    """The same in DuckDB SQL over the view pages, the first `rounds` rounds unrolled: the same where no link
    leaves a host, else verdicts near the threshold can differ from settled ranks."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(r.verdict)}, {quote(r.host)}, {quote(r.path)}, {quote(r.name)})" for r in rules)
    href = r"""(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s<>]+)"""
    low = lambda x: f"translate({x}, '{ASCII_UPPER}', '{ASCII_LOWER}')"
    d = s.damping
    sql = f"""with rules(verdict, host, path, name) as (values {rows}),
parts as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
hp as (select page_id, html, coalesce({low("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from parts),
fit as (select h.page_id, h.host, h.path, r.name, r.verdict, row_number() over (partition by h.page_id, h.host, h.path order by length(r.name) desc) as k
  from hp h join rules r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path)),
ruled as (select h.page_id, h.host, h.path, f.name as rule, f.verdict as ruled from hp h left join (select * from fit where k = 1) f on h.page_id = f.page_id and h.host = f.host and h.path = f.path),
marks as (select host, count(*) filter (ruled = 'allow') as a, count(*) filter (ruled = 'block') as b, count(*) as pages from ruled group by host),
seeds as (select host, {1 - d} * a as trust, {1 - d} * b as distrust from marks where a > 0 or b > 0),
links as (select host as src, {low("unnest(regexp_extract_all(html, '" + href + "', 1))")} as dst from hp),
edges as (select src, dst, count(*)::double as w from links where src <> '' and dst <> '' and src <> dst group by all),
shares as (select src, dst, w / sum(w) over (partition by src) as f, w / sum(w) over (partition by dst) as g from edges),
s0 as (select * from seeds)"""
    for i in range(s.rounds):
        sql += f""",
s{i + 1} as (select host, sum(trust) as trust, sum(distrust) as distrust from (select * from seeds
  union all select dst, {d} * trust * f, 0 from shares join s{i} on src = host union all select src, 0, {d} * distrust * g from shares join s{i} on dst = host) group by host)"""
    return sql + f"""
select r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, case when round(t.distrust - t.trust, 9) >= {(1 - d) * s.share} * m.pages then 'block' end, 'allow') as verdict
from ruled r left join s{s.rounds} t on r.host = t.host left join marks m on r.host = m.host"""
