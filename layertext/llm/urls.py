"""URL filter by a tree of path templates; DataFrame functions only.

Rules decide the urls that they fit and thereby label them.  For each host the segments of the paths form a tree.  From
the root down, each level's segments are generalised: digits become `#`; a node with many children, none of them
frequent, gets one wildcard branch; labelled branches whose rates of blocked urls don't differ significantly from that of
all branches of their node together are similar to one another, and are merged into the wildcard branch.  A template is rejected by its smoothed purity: the share of blocked among
its labelled urls, drawn towards the same template's share in the whole domain, which is drawn towards a clean prior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layertext.llm import shared

#: (verdict, rule): a rule is a host and a path; it fits the host, its subdomains and the paths that start with its own.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Levels of the tree; what lies deeper counts as one last segment.
DEPTH = 4
#: A node with so many children merges those that have at most this share of its urls.
CHILDREN, RARE = 20, 0.05
#: Labelled urls that a branch needs to be compared, and the deviations within which rates count as equal.
LABELLED, DEVIATIONS = 5, 1.96
#: Prior rate of blocked urls, the weights of the prior and of the domain, and the purity from which a template is rejected.
PRIOR, PRIOR_WEIGHT, DOMAIN_WEIGHT, REJECT = 0.1, 10.0, 5.0, 0.5

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next / ? # or the end, with A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), *_AZ), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for a null or where :// is missing."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], verdict: bool = False) -> Column:
    """The longest rule that fits, or its verdict; else null.  Of rules of one length the first is taken."""
    out = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(kind if verdict else rule)).otherwise(out)
    return out


def _levels(path: Column) -> list[Column]:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shapes = F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    first = [F.coalesce(F.get(shapes, F.lit(i)), F.lit("")) for i in range(DEPTH - 1)]
    return [*first, F.array_join(F.slice(shapes, DEPTH, 1 << 20), "/")]


def templates(leaves: DataFrame) -> DataFrame:
    """Leaves (host, s1.., n, labelled, blocked) with their generalised segments t1.. ."""
    for d in range(1, DEPTH + 1):
        node = ["host", *[f"t{i}" for i in range(1, d)]]
        seg = f"s{d}"
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        child = leaves.groupBy(*node, seg).agg(*sums)
        parent = child.groupBy(*node).agg(F.count("*").alias("k"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
        # a host may have a large share of all nodes: written, so that the rows of hot ones can be told and dealt out
        child = shared.join_small(shared.written(child, "children"), shared.written(parent, "parents"), node)
        variable = (F.col("k") >= CHILDREN) & (F.col("n") <= F.col("all_n") * RARE)
        rate = (F.col("all_blocked") + PRIOR) / (F.col("all_labelled") + 1.0)
        spread = F.sqrt(rate * (1.0 - rate) / F.greatest(F.col("labelled"), F.lit(1)))
        off = F.abs(F.col("blocked") / F.greatest(F.col("labelled"), F.lit(1)) - rate)
        similar = (F.col("labelled") >= LABELLED) & (F.col("labelled") < F.col("all_labelled")) & (off <= spread * DEVIATIONS)
        merged = F.when((F.col(seg) != "") & (variable | similar), F.lit("*")).otherwise(F.col(seg))
        # written, for the next level reads it three times
        named = shared.written(child.select(*node, seg, merged.alias(f"t{d}")), "named")
        leaves = shared.written(shared.join_small(leaves, named, [*node, seg]), "leaves")
    return leaves


def judged(leaves: DataFrame) -> DataFrame:
    """Leaves with template, purity and the method's verdict."""
    levels = [f"t{i}" for i in range(1, DEPTH + 1)]
    domain = F.substring_index("host", ".", -2)
    leaves = leaves.withColumn("domain", domain)
    wide = leaves.groupBy("domain", *levels).agg(F.sum("labelled").alias("dl"), F.sum("blocked").alias("db"))
    own = leaves.groupBy("domain", "host", *levels).agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
    both = shared.join_small(shared.written(own, "own"), shared.written(wide, "wide"), ["domain", *levels])
    rate = (F.col("db") + PRIOR_WEIGHT * PRIOR) / (F.col("dl") + PRIOR_WEIGHT)
    both = both.withColumn("purity", (F.col("hb") + DOMAIN_WEIGHT * rate) / (F.col("hl") + DOMAIN_WEIGHT))
    out = shared.join_small(leaves, shared.written(both.select("host", *levels, "purity"), "purity"), ["host", *levels])
    named = F.concat(F.lit("/"), F.array_join(F.filter(F.array(*levels), lambda s: s != ""), "/"))
    return out.withColumn("template", named).withColumn("method", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of pages (page_id, url).

    A null url, or one without ://, has an empty host and path; such urls form one template and are allowed unless a rule
    says otherwise.  The verdict is the longest fitting rule's, else the template's.  Repeated rows count each and get
    equal results; ids may be null; an empty table gives an empty result.  Other columns are ignored.  The rules are a
    short list; the templates are as many as the sites' page types and are not collected.
    """
    url = pages["url"].cast("string")
    rows = pages.select(pages["page_id"], host_of(url).alias("host"), path_of(url).alias("path"))
    levels = {f"s{i}": e for i, e in enumerate(_levels(F.col("path")), 1)}
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("said", rule_of(F.col("host"), F.col("path"), rules, verdict=True)).withColumns(levels)
    keys = ["host", *levels]
    leaves = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    found = shared.written(judged(templates(shared.written(leaves, "leaves"))).select(*keys, "template", "purity", "method"), "templates")
    out = shared.join_small(rows, found, keys)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "method").alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The same in DuckDB's SQL over pages."""

    def cases(what: int) -> str:
        out = []
        for x in sorted(rules, key=lambda r: -len(r[1])):
            at, _, rest = x[1].partition("/")
            out.append(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}') THEN '{x[what]}'")
        return f"CASE {' '.join(out)} END"

    s, t = [f"s{i}" for i in range(1, DEPTH + 1)], [f"t{i}" for i in range(1, DEPTH + 1)]
    firsts = ", ".join(f"coalesce(shapes[{i}], '') AS s{i}" for i in range(1, DEPTH))
    parts = [
        f"u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{_AZ[0]}', '{_AZ[1]}'), '') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages)",
        f"r AS (SELECT *, {cases(1)} AS rule, {cases(0)} AS said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS shapes FROM u)",
        f"p AS (SELECT *, {firsts}, array_to_string(shapes[{DEPTH}:], '/') AS s{DEPTH} FROM r)",
        f"l0 AS (SELECT host, {', '.join(s)}, count(*) AS n, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked FROM p GROUP BY ALL)",
    ]
    for d in range(1, DEPTH + 1):
        node = ", ".join(["host", *t[: d - 1]])
        over = f"OVER (PARTITION BY {node})"
        rate = f"((ab + {PRIOR}) / (al + 1.0))"
        similar = f"labelled >= {LABELLED} AND labelled < al AND abs(blocked / greatest(labelled, 1) - {rate}) <= sqrt({rate} * (1.0 - {rate}) / greatest(labelled, 1)) * {DEVIATIONS}"
        parts += [
            f"c{d} AS (SELECT {node}, s{d}, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM l{d - 1} GROUP BY ALL)",
            f"w{d} AS (SELECT *, count(*) {over} AS k, sum(n) {over} AS an, sum(labelled) {over} AS al, sum(blocked) {over} AS ab FROM c{d})",
            f"m{d} AS (SELECT {node}, s{d}, CASE WHEN s{d} <> '' AND ((k >= {CHILDREN} AND n <= an * {RARE}) OR ({similar})) THEN '*' ELSE s{d} END AS t{d} FROM w{d})",
            f"l{d} AS (SELECT l.*, m.t{d} FROM l{d - 1} l JOIN m{d} m USING ({node}, s{d}))",
        ]
    tt = ", ".join(t)
    parts += [
        f"g AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM l{DEPTH})",
        f"dw AS (SELECT domain, {tt}, sum(labelled) AS dl, sum(blocked) AS db FROM g GROUP BY ALL)",
        f"hw AS (SELECT domain, host, {tt}, sum(labelled) AS hl, sum(blocked) AS hb FROM g GROUP BY ALL)",
        f"q AS (SELECT host, {tt}, (hb + {DOMAIN_WEIGHT} * ((db + {PRIOR_WEIGHT * PRIOR}) / (dl + {PRIOR_WEIGHT}))) / (hl + {DOMAIN_WEIGHT}) AS purity FROM hw JOIN dw USING (domain, {tt}))",
        f"j AS (SELECT host, {', '.join(s)}, '/' || array_to_string(list_filter([{tt}], lambda x: x <> ''), '/') AS template, purity FROM g JOIN q USING (host, {tt}))",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity FROM p JOIN j USING (host, {', '.join(s)})"
