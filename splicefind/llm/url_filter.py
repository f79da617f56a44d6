"""URL filters: suffix/prefix rules first, then a path-template tree per host.

The tree of a host has one level per path segment.  A segment with a digit, or a very long
one, is a wildcard.  Level by level from the host down, the branches of one parent and one
shape (file ending, with or without further segments) are held against each other: a branch
whose rate of blocked labels differs from that of all its siblings by a two-proportion test
keeps its name; all others (alike, sparsely labelled or unlabelled) merge into one wildcard
branch and share its evidence.  A node's smoothed purity is its own blocked share with the
parent's purity as prior, down to the host, whose prior is even; so branches without labels
inherit what their host shows.  A template (the node where a path ends) is rejected when
its purity passes a threshold.  Labels are the urls that the rules decide.

Paths of more than ``LEVELS`` segments keep the rest as one last segment, compared whole.

Counting starts with one aggregation to distinct (host, generalised path) rows with map-side
combine, so a host that holds a third of all urls shuffles as few rows as any other; each
level is one job over these rows, stored in the shared folder.  Only built-in
functions are used; nothing is collected but the greatest depth.

Defined cases: null urls and those without ``://`` have empty host and path, no rule and
the verdict of their template.  Repeated pages are judged alike.  Other columns pass through
unless they bear the name of a result column (host, path, rule, verdict, template, purity), which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (host and path prefix, verdict) of the registered query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = 8
LONG = 32
CRITICAL = 3.84  # square of the normal quantile at 95 %
ALPHA = 4.0
REJECT_ABOVE = 0.7
RESULT = ("host", "path", "rule", "verdict", "template", "purity")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text or null, its verdict or null): of the rules that fit, the longest, then the first by text."""
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones wrap earlier ones
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, decided = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    return rule, decided


def segments(path: Column, levels: int = LEVELS) -> Column:
    """Path segments with variable ones as wildcards; those beyond ``levels`` are one last segment."""
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+")
    variable = lambda s: s.rlike("[0-9]") | (F.length(s) >= LONG)
    parts = F.transform(parts, lambda s: F.when(variable(s), F.concat(F.lit("*"), ending(s))).otherwise(s))
    rest = F.array(F.array_join(F.slice(parts, levels + 1, F.greatest(F.size(parts), F.lit(1))), "/"))
    return F.when(F.size(parts) > levels, F.concat(F.slice(parts, 1, levels), rest)).otherwise(parts)


def ending(segment: Column) -> Column:
    """The file ending of a segment, or nothing."""
    return F.regexp_extract(segment, r"(\.[a-z]{2,5})$", 1)


def templates(urls: DataFrame, alpha: float = ALPHA, critical: float = CRITICAL, levels: int = LEVELS) -> DataFrame:
    """(host, segments) -> template and its smoothed blocked purity.

    ``urls`` has host, segments and blocked (1, 0, or null without a label).
    """
    scratch = Scratch(urls.sparkSession)
    leaf = urls.groupBy("host", "segments").agg(F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    leaf = scratch.put("leaf", leaf.withColumn("nodes", F.array(F.lit(""))))
    depth = leaf.agg(F.coalesce(F.max(F.size("segments")), F.lit(0)).alias("n")).first()["n"]
    place, names = ["host", "parent", "shape"], ["host", "parent", "shape", "name"]
    for level in range(1, min(depth, levels + 1) + 1):
        at = leaf.withColumns({"parent": F.element_at("nodes", -1), "name": F.get("segments", F.lit(level - 1))})
        at = at.withColumn("shape", F.concat(ending(F.col("name")), F.when(F.size("segments") > level, "/").otherwise("")))
        live = at.where(F.size("segments") >= level)
        branch = live.groupBy(*names).agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
        pool = branch.groupBy(*place).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count("*").alias("siblings"))
        both = branch.join(pool, place)
        rest, per = F.col("all_n") - F.col("n"), F.try_divide
        share = per(F.col("all_b"), F.col("all_n"))
        gap = per(F.col("b"), F.col("n")) - per(F.col("all_b") - F.col("b"), rest)
        differs = gap * gap > critical * (share * (1 - share) * (per(F.lit(1.0), F.col("n")) + per(F.lit(1.0), rest)))  # null without labels on both sides
        kept = F.coalesce(differs, F.lit(False)) | (F.col("siblings") == 1)
        named = both.select(*names, F.when(kept, F.col("name")).otherwise(F.concat(F.lit("*"), ending(F.col("name")))).alias("label"))
        grown = live.join(named, names).withColumn("nodes", F.concat("nodes", F.array(F.concat("parent", F.lit("/"), "label"))))
        done = at.where(F.size("segments") < level)
        leaf = scratch.put("tree", grown.select(leaf.columns).unionByName(done.select(leaf.columns)))
    line = leaf.select("host", "segments", "labelled", "bad", F.posexplode("nodes").alias("level", "node"))
    node = line.groupBy("host", "node").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    line = line.select("host", "segments", "level", "node").join(node, ["host", "node"])
    line = line.groupBy("host", "segments").agg(F.array_sort(F.collect_list(F.struct("level", "node", "n", "b"))).alias("line"))
    purity = F.aggregate("line", F.lit(0.5), lambda prior, x: (x["b"] + alpha * prior) / (x["n"] + alpha))
    return line.select("host", "segments", F.element_at("line", -1)["node"].alias("template"), purity.alias("purity"))


def url_filter(pages: DataFrame, url: str = "url", rules=RULES, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity."""
    rest = [c for c in pages.columns if c not in RESULT]
    rows = pages.select(F.struct(*rest).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": decided, "segments": segments(F.col("path"))})
    tree = templates(rows.select("host", "segments", F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0).alias("blocked")))
    out = rows.join(tree, ["host", "segments"])
    learned = F.when(F.col("purity") > reject_above, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("row.*", "host", "path", "rule", F.coalesce("decided", learned).alias("verdict"), "template", "purity")


def oracle_sql(rules=RULES, levels: int = LEVELS) -> str:
    """The same in SQL, one chain of tables a level."""
    fits = lambda t: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*t.split("/", 1))
    first = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in first) + " END"
    decided = "CASE rule " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in first) + " END"
    end = lambda c: rf"regexp_extract({c}, '(\.[a-z]{{2,5}})$', 1)"
    parts = "string_split_regex(regexp_replace(path, '^/+|/+$', '', 'g'), '/+')"
    parts = f"list_transform({parts}, lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) >= {LONG} THEN '*' || {end('s')} ELSE s END)"
    sql = [
        f"""WITH u AS MATERIALIZED (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        f"r AS MATERIALIZED (SELECT *, {rule} AS rule, {parts} AS parts FROM u)",
        f"d AS MATERIALIZED (SELECT *, {decided} AS decided, CASE WHEN len(parts) > {levels} THEN list_append(list_slice(parts, 1, {levels}), array_to_string(list_slice(parts, {levels + 1}, len(parts)), '/')) ELSE parts END AS segs FROM r)",
        f"f AS MATERIALIZED (SELECT host, segs, count(decided) AS n, count(*) FILTER (decided = 'block') AS b FROM d GROUP BY ALL), l0 AS MATERIALIZED (SELECT *, '' AS p, (sum(b) OVER (PARTITION BY host) + {ALPHA}::DOUBLE * 0.5) / (sum(n) OVER (PARTITION BY host) + {ALPHA}::DOUBLE) AS pure FROM f)",
    ]
    for k in range(1, levels + 2):
        gap = "((b / n) - (ab - b) / (an - n))"
        sql += [
            f"s{k} AS MATERIALIZED (SELECT *, segs[{k}] AS name, {end(f'segs[{k}]')} || CASE WHEN len(segs) > {k} THEN '/' ELSE '' END AS shape FROM l{k - 1} WHERE len(segs) >= {k})",
            f"b{k} AS (SELECT host, p, shape, name, sum(n) AS n, sum(b) AS b FROM s{k} GROUP BY ALL), q{k} AS (SELECT *, sum(n) OVER w AS an, sum(b) OVER w AS ab, count(*) OVER w AS c FROM b{k} WINDOW w AS (PARTITION BY host, p, shape))",
            f"n{k} AS MATERIALIZED (SELECT host, p, shape, name, CASE WHEN c = 1 OR (n > 0 AND an > n AND {gap} * {gap} > {CRITICAL}::DOUBLE * ((ab / an) * (1 - ab / an) * (1.0::DOUBLE / n + 1.0::DOUBLE / (an - n)))) THEN name ELSE '*' || {end('name')} END AS label FROM q{k})",
            f"t{k} AS (SELECT s.host, segs, n, b, s.p || '/' || label AS p, pure FROM s{k} s JOIN n{k} USING (host, p, shape, name))",
            f"l{k} AS MATERIALIZED (SELECT host, segs, n, b, p, (sum(b) OVER w + {ALPHA}::DOUBLE * pure) / (sum(n) OVER w + {ALPHA}::DOUBLE) AS pure FROM t{k} WINDOW w AS (PARTITION BY host, p) UNION ALL SELECT host, segs, n, b, p, pure FROM l{k - 1} WHERE len(segs) < {k})",
        ]
    return ", ".join(sql) + f" SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN pure > {REJECT_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict FROM d JOIN l{levels + 1} USING (host, segs)"
