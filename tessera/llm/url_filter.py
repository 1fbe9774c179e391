"""URL filter by rules and a path-template tree (operator 6, DataFrame functions only).

Pages that a rule fits are judged by the longest one. They are also the
labels from which the tree judges the others: per host, path segments become
a tree; segments that vary (digits, hexadecimal names, or one of many rare
siblings) become wildcards, siblings whose share of blocked labels doesn't
differ from their parent's (chi-squared, one degree of freedom) are merged,
and a template is rejected if its smoothed share of blocked labels is high. The
share is smoothed down the tree: a branch begins with its parent's share, which
counts as PRIOR labels, and the host with one half; so a branch with few labels
or none takes after its host, and one that holds all labels of its parent has
its share, for the same labels are no new evidence.

The tree works on counted distinct typed paths, not on pages, so a host with a
third of all pages adds few rows; the last join, from pages to templates, is
one whose skew Spark splits. A host without labels is allowed.

Defined results: a null url, or one without "://", has an empty host and path,
no rule, and the verdict allow; every input row gives one row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, keep

#: (verdict, host, path); a rule fits its host and all subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Levels of the tree; what lies deeper is a wildcard at the end of the last one.
LEVELS = 4
#: A parent with more children than this has its rare children (below the mean) generalised.
MANY_CHILDREN = 16
#: Chi-squared below which a branch counts as like its parent (95 %).
ALIKE = 3.84
#: Labels that a parent's share counts as; reject from this smoothed share of blocked labels on.
PRIOR, REJECT = 2.0, 0.8
END, TAIL, ANY, HEX, LONG = "{end}", "/{tail}", "*", "{hex}", "{long}"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def typed_segments(path: Column) -> list[Column]:
    """LEVELS segments of a path, with digit runs, hexadecimal names and very long ones replaced."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")

    def typed(s: Column) -> Column:
        return F.when(F.length(s) > 64, LONG).when(s.rlike("^[0-9a-fA-F-]{16,}$"), HEX).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))

    found = [F.coalesce(typed(F.get(segments, F.lit(k))), F.lit(END)) for k in range(LEVELS)]
    found[-1] = F.when(F.size(segments) > LEVELS, F.concat(found[-1], F.lit(TAIL))).otherwise(found[-1])
    return found


def template_tree(pages: DataFrame) -> DataFrame:
    """host, s0.. (typed segments), template, template_labelled, template_blocked and template_share of each distinct typed path.

    ``pages`` has host, s0.., and label (block, allow or null).
    """
    segments = [f"s{k}" for k in range(LEVELS)]
    total = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    nodes = pages.groupBy("host", *segments).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked"))
    for k in range(LEVELS):
        nodes = keep(nodes, "url-nodes")  # each level reads the last one twice
        above = ["host", *(f"t{i}" for i in range(k))]
        child = nodes.groupBy(*above, f"s{k}").agg(*total)
        parent = child.groupBy(*above).agg(F.count(F.lit(1)).alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
        c, n, b, all_n, all_b = F.col("children"), *(F.col(x).cast("double") for x in ("labelled", "blocked", "all_labelled", "all_blocked"))
        gap = b * all_n - n * all_b
        alike = (gap == 0) | (gap * gap < F.lit(ALIKE) * n * all_b * (all_n - all_b))
        name = F.when(c == 1, F.col(f"s{k}")).when((c > MANY_CHILDREN) & (F.col("n") * c < F.col("all_n")), ANY).when(alike, ANY).otherwise(F.col(f"s{k}"))
        named = child.join(parent, above).select(*above, f"s{k}", name.alias(f"t{k}"))
        nodes = nodes.join(named, [*above, f"s{k}"])
    nodes = keep(nodes, "url-nodes")
    templates = ["host", *(f"t{k}" for k in range(LEVELS))]
    # down the tree: the share of each branch begins with its parent's
    above, shares = [], None
    for k in range(LEVELS + 1):
        sums = nodes.groupBy(*templates[: k + 1]).agg(F.sum("labelled").alias("template_labelled"), F.sum("blocked").alias("template_blocked"))
        held = sums.join(shares, above) if above else sums.withColumns({"share": F.lit(0.5), "above": F.lit(-1)})
        smoothed = (F.col("template_blocked") + F.lit(PRIOR) * F.col("share")) / (F.col("template_labelled") + F.lit(PRIOR))
        shares = held.withColumn("share", F.when(F.col("template_labelled") == F.col("above"), F.col("share")).otherwise(smoothed))
        above = templates[: k + 1]
        last, shares = shares.drop("above"), shares.select(*above, "share", F.col("template_labelled").alias("above"))
    sums = last.withColumnRenamed("share", "template_share")
    return nodes.join(sums, templates).select("host", *segments, F.concat(F.lit("/"), F.concat_ws("/", *templates[1:])).alias("template"), "template_labelled", "template_blocked", "template_share")


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id") -> DataFrame:
    """page id, host, path, rule, verdict, and for pages without a rule their template, its label counts and its smoothed share."""
    segments = [f"s{k}" for k in range(LEVELS)]
    split = pages.select(F.col(f"`{id_column}`").alias("page_id"), *(c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path"))))
    rule, label = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), label.alias("label"))
    typed = ruled.select("*", *(c.alias(n) for c, n in zip(typed_segments(F.col("path")), segments)))
    sure = ruled.where(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("label").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(0).cast("long").alias("template_labelled"), F.lit(0).cast("long").alias("template_blocked"), F.lit(None).cast("double").alias("template_share"))
    reject = F.col("template_share") >= F.lit(REJECT)
    learned = typed.where(F.col("rule").isNull()).join(template_tree(typed), ["host", *segments]).select("page_id", "host", "path", "rule", F.when(reject, "block").otherwise("allow").alias("verdict"), "template", "template_labelled", "template_blocked", "template_share")
    return sure.unionAll(learned)


def duckdb_sql(rules=RULES) -> str:
    """The same, for DuckDB."""
    segments, cases = [f"s{k}" for k in range(LEVELS)], sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in cases]
    case = lambda found: "CASE " + " ".join(f"{f} '{x}'" for f, x in zip(fits, found)) + " END"
    typed = lambda s: f"CASE WHEN length({s}) > 64 THEN '{LONG}' WHEN regexp_matches({s}, '^[0-9a-fA-F-]{{16,}}$') THEN '{HEX}' ELSE regexp_replace({s}, '[0-9]+', '{{n}}', 'g') END"
    of = [f"coalesce({typed(f'g[{k + 1}]')}, '{END}')" for k in range(LEVELS)]
    of[-1] = f"CASE WHEN len(g) > {LEVELS} THEN {of[-1]} || '{TAIL}' ELSE {of[-1]} END"
    with_ = [
        r"p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages)",
        f"r AS (SELECT *, {case([h + p for _, h, p in cases])} AS rule, {case([v for v, _, _ in cases])} AS label, string_split(regexp_replace(path, '^/', ''), '/') AS g FROM p)",
        f"y AS (SELECT page_id, host, path, rule, label, {', '.join(f'{x} AS {n}' for x, n in zip(of, segments))} FROM r)",
        f"n0 AS (SELECT host, {', '.join(segments)}, count(*) AS n, count(label) AS labelled, count(*) FILTER (WHERE label = 'block') AS blocked FROM y GROUP BY ALL)",
    ]
    for k in range(LEVELS):
        above = ", ".join(["host", *(f"t{i}" for i in range(k))])
        with_ += [
            f"c{k} AS (SELECT {above}, s{k}, sum(n) AS n, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b FROM n{k} GROUP BY ALL)",
            f"q{k} AS (SELECT *, count(*) OVER w AS c, sum(n) OVER w AS an, sum(l) OVER w AS al, sum(b) OVER w AS ab FROM c{k} WINDOW w AS (PARTITION BY {above}))",
            f"m{k} AS (SELECT {above}, s{k}, CASE WHEN c = 1 THEN s{k} WHEN c > {MANY_CHILDREN} AND n * c < an THEN '{ANY}' WHEN b * al - l * ab = 0 OR (b * al - l * ab) * (b * al - l * ab) < {ALIKE}::DOUBLE * l * ab * (al - ab) THEN '{ANY}' ELSE s{k} END AS t{k} FROM q{k})",
            f"n{k + 1} AS (SELECT * FROM n{k} JOIN m{k} USING ({above}, s{k}))",
        ]
    tops = [f"t{k}" for k in range(LEVELS)]
    prior, before = f"{PRIOR}::DOUBLE", "0.5::DOUBLE"
    for k in range(LEVELS + 1):
        group = ", ".join(["host", *tops[:k]])
        join = f" JOIN h{k - 1} USING ({', '.join(['host', *tops[: k - 1]])})" if k else ""
        with_ += [
            f"b{k} AS (SELECT {group}, sum(labelled)::BIGINT AS tl, sum(blocked)::BIGINT AS tb FROM n{LEVELS} GROUP BY ALL)",
            f"h{k} AS (SELECT {group}, b{k}.tl, b{k}.tb, {f'CASE WHEN b{k}.tl = h{k - 1}.tl THEN h{k - 1}.share ELSE' if k else ''} (b{k}.tb + {prior} * {f'h{k - 1}.share' if k else before}) / (b{k}.tl + {prior}) {'END' if k else ''} AS share FROM b{k}{join})",
        ]
    all_tops = ", ".join(tops)
    with_.append(f"z AS (SELECT host, {', '.join(segments)}, '/' || concat_ws('/', {all_tops}) AS template, tl, tb, share FROM n{LEVELS} JOIN h{LEVELS} USING (host, {all_tops}))")
    return (
        f"WITH {', '.join(with_)} SELECT page_id, host, path, rule, label AS verdict, NULL::VARCHAR AS template, 0::BIGINT AS template_labelled, 0::BIGINT AS template_blocked, NULL::DOUBLE AS template_share FROM y WHERE rule IS NOT NULL "
        f"UNION ALL SELECT page_id, host, path, rule, CASE WHEN share >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END, template, tl, tb, share FROM y JOIN z USING (host, {', '.join(segments)}) WHERE rule IS NULL"
    )
