"""Documentation and security operators over the fixtures and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import docs, extract, security
from quarry.plans.fixtures import docs as doc_files
from quarry.plans.fixtures import files, fragments, values
from quarry.plans.tables import table

ALL = security.ALL_CWES


def md_sections(spark, sf_dir):
    return docs.sections(doc_files(spark)).select("id", "level", "start_line", "end_line", "snippet")


def section_extent(spark, sf_dir):
    """Lines of documents as headings: a line's level is the number of its words modulo 6, plus 1."""
    rows = table(spark, sf_dir, "documents")
    content = F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x: F.concat(F.repeat(F.lit("#"), F.size(F.split(x, " ")) % 6 + 1), F.lit(" "), x)))
    found = docs.extents(rows.select(F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return found.where("level > 0").select("path", "start_line", "end_line", "level")


def path_like_links(spark, sf_dir):
    f = files(spark, "harbour")
    return docs.links(docs.sections(doc_files(spark)), f, extract.symbols(f)).select("id", "target", "kind", "broken")


REFS = ["src/tide.rs::metres", "src/berth.rs#4-6", "src/crane/hook.rs", "manual/harbour.md::## moving ships", "src/tide.rs::storm", "src/pilot.rs", "src/tide.rs#2-70", "manual/harbour.md::## Sinking"]


def doc_slices(spark, sf_dir):
    f = files(spark, "harbour")
    refs = spark.createDataFrame([("harbour", r) for r in REFS], "repo string, ref string")
    return docs.slices(refs, f.unionByName(doc_files(spark)), extract.symbols(f)).select("ref", "start_line", "end_line", "error")


def doc_staleness(spark, sf_dir):
    """Users as files: clicks change code, views change documents; each user's document links to the next user's code."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    code = e.where("event_type = 'click'").select(F.concat(F.lit("src/u"), F.col("u").cast("string"), F.lit(".py")).alias("path"), "ts")
    doc = e.where("event_type = 'view'").select(F.concat(F.lit("docs/u"), F.col("u").cast("string"), F.lit(".md")).alias("path"), "ts")
    users = e.select("u").distinct()
    linked = users.select(F.col("u").cast("string").alias("id"), F.concat(F.lit("docs/u"), F.col("u").cast("string"), F.lit(".md")).alias("file"), F.concat(F.lit("src/u"), (F.col("u") + 1).cast("string"), F.lit(".py")).alias("target"), F.lit(False).alias("broken"))
    return docs.stale_sections(linked, code.unionByName(doc))


def doc_status(spark, sf_dir):
    f = files(spark, "harbour")
    s = docs.sections(doc_files(spark))
    linked = docs.links(s, f, extract.symbols(f))
    return docs.status(s, linked, s.select("id", (F.col("level") == 2).alias("stale")))


def security_findings(spark, sf_dir):
    return security.findings(fragments(spark), ALL).select("path", "line", "cwe", "status")


def security_proofs(spark, sf_dir):
    return security.findings(fragments(spark), prove=True).select("path", "cwe", "status", "witness")


def gate_decision(spark, sf_dir):
    f = fragments(spark)
    return security.gate(f, security.findings(f, prove=True)).select("path", "action", "n_sites", "n_findings", "n_proved")


def secret_scan(spark, sf_dir):
    return security.secrets(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (md_sections, section_extent, path_like_links, doc_slices, doc_staleness, doc_status, security_findings, security_proofs, gate_decision, secret_scan)}

ORACLES = {
    "md_sections": values('id, level, start_line, end_line, snippet', [
        ('manual/harbour.md::# Harbour', 1, 1, 12, 'How grab and tide_at work.\n\n## Moving ships\n\nSee src/berth.rs, then src/pilot.rs.\n\n## Lifting\n<!-- quarry: src/crane/hook.rs -->\n### Weights\nabout weigh and metres'),
        ('manual/harbour.md::## Lifting', 2, 9, 12, '<!-- quarry: src/crane/hook.rs -->\n### Weights\nabout weigh and metres'),
        ('manual/harbour.md::## Moving ships', 2, 5, 8, 'See src/berth.rs, then src/pilot.rs.'),
        ('manual/harbour.md::### Weights', 3, 11, 12, 'about weigh and metres'),
        ('manual/notes.md', 0, 1, 1, 'Only a note on unload, without a heading.'),
    ]),
    "section_extent": """WITH l AS (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS every FROM documents),
x AS (SELECT path, len(every) AS n, unnest(range(1, len(every) + 1)) AS line, unnest(every) AS t FROM l),
h AS (SELECT path, n, line, len(string_split(t, ' ')) % 6 + 1 AS level FROM x WHERE regexp_matches(t, '\\S') AND NOT starts_with(t, '#'))
SELECT h.path, h.line::INTEGER AS start_line, coalesce((SELECT min(b.line) - 1 FROM h b WHERE b.path = h.path AND b.line > h.line AND b.level <= h.level), h.n)::INTEGER AS end_line, h.level::INTEGER AS level FROM h""",
    "path_like_links": values('id, target, kind, broken', [
        ('manual/harbour.md::# Harbour', '::berth', 'heuristic', False),
        ('manual/harbour.md::# Harbour', '::crane', 'heuristic', False),
        ('manual/harbour.md::# Harbour', '::grab', 'heuristic', False),
        ('manual/harbour.md::# Harbour', '::hook', 'heuristic', False),
        ('manual/harbour.md::# Harbour', '::metres', 'heuristic', False),
        ('manual/harbour.md::# Harbour', '::tide_at', 'heuristic', False),
        ('manual/harbour.md::# Harbour', 'src/berth.rs', 'heuristic', False),
        ('manual/harbour.md::# Harbour', 'src/crane/hook.rs', 'explicit', False),
        ('manual/harbour.md::# Harbour', 'src/pilot.rs', 'heuristic', True),
        ('manual/harbour.md::## Lifting', '::crane', 'heuristic', False),
        ('manual/harbour.md::## Lifting', '::hook', 'heuristic', False),
        ('manual/harbour.md::## Lifting', '::metres', 'heuristic', False),
        ('manual/harbour.md::## Lifting', 'src/crane/hook.rs', 'explicit', False),
        ('manual/harbour.md::## Moving ships', '::berth', 'heuristic', False),
        ('manual/harbour.md::## Moving ships', 'src/berth.rs', 'heuristic', False),
        ('manual/harbour.md::## Moving ships', 'src/pilot.rs', 'heuristic', True),
        ('manual/harbour.md::### Weights', '::metres', 'heuristic', False),
        ('manual/notes.md', '::unload', 'heuristic', False),
    ]),
    "doc_slices": values('ref, start_line, end_line, error', [
        ('manual/harbour.md::## Sinking', None, None, 'HeadingNotFound'),
        ('manual/harbour.md::## moving ships', 5, 8, None),
        ('src/berth.rs#4-6', 4, 6, None),
        ('src/crane/hook.rs', 1, 4, None),
        ('src/pilot.rs', None, None, 'FileNotFound'),
        ('src/tide.rs#2-70', None, None, 'LineRangeOutOfBounds'),
        ('src/tide.rs::metres', 7, 7, None),
        ('src/tide.rs::storm', None, None, 'SymbolNotFound'),
    ]),
    "doc_staleness": """WITH c AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1), v AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT u.user_id::VARCHAR AS id, coalesce(c.ts > coalesce(v.ts, TIMESTAMP '0001-01-01'), FALSE) AS stale FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c ON c.user_id = u.user_id + 1 LEFT JOIN v ON v.user_id = u.user_id""",
    "doc_status": values('files, sections, stale_ids, broken_links', [
        (2, 5, ['manual/harbour.md::## Lifting', 'manual/harbour.md::## Moving ships'], 2),
    ]),
    "security_findings": values('path, line, cwe, status', [
        ('both.c', 1, 'CWE-190', 'pattern_only'),
        ('both.c', 2, 'CWE-191', 'pattern_only'),
        ('copies.c', 1, 'CWE-680', 'pattern_only'),
        ('file.py', 1, 'CWE-22', 'pattern_only'),
        ('file.py', 2, 'CWE-22', 'pattern_only'),
        ('grow.c', 1, 'CWE-190', 'pattern_only'),
        ('less.c', 1, 'CWE-191', 'pattern_only'),
        ('login.py', 1, 'CWE-798', 'pattern_only'),
        ('loose.c', 1, 'CWE-190', 'pattern_only'),
        ('opaque.c', 1, 'CWE-190', 'unknown'),
        ('print.c', 1, 'CWE-134', 'pattern_only'),
        ('print.c', 3, 'CWE-134', 'pattern_only'),
        ('print.c', 3, 'CWE-134', 'pattern_only'),
        ('product.c', 1, 'CWE-190', 'pattern_only'),
        ('room.rs', 1, 'CWE-190', 'pattern_only'),
        ('share.c', 1, 'CWE-369', 'pattern_only'),
        ('shell.py', 1, 'CWE-78', 'pattern_only'),
        ('shell.py', 2, 'CWE-78', 'pattern_only'),
        ('shifted.c', 1, 'CWE-190', 'pattern_only'),
        ('state.py', 2, 'CWE-502', 'pattern_only'),
        ('unit.c', 1, 'CWE-190', 'pattern_only'),
    ]),
    "security_proofs": values('path, cwe, status, witness', [
        ('both.c', 'CWE-190', 'proven_vulnerable', 'x = 9223372036854775808'),
        ('both.c', 'CWE-191', 'proven_vulnerable', 'y = 0'),
        ('copies.c', 'CWE-680', 'proven_vulnerable', 'blocks = 9223372036854775808'),
        ('grow.c', 'CWE-190', 'proven_vulnerable', 'used = 9223372036854775808'),
        ('less.c', 'CWE-191', 'proven_vulnerable', 'size = 0'),
        ('loose.c', 'CWE-190', 'pattern_only', None),
        ('opaque.c', 'CWE-190', 'unknown', None),
        ('product.c', 'CWE-190', 'proven_vulnerable', 'height = 9223372036854775808'),
        ('room.rs', 'CWE-190', 'proven_vulnerable', 'items = 9223372036854775808'),
        ('share.c', 'CWE-369', 'proven_vulnerable', 'workers = 0'),
        ('shifted.c', 'CWE-190', 'proven_vulnerable', 'order = 9223372036854775808'),
        ('unit.c', 'CWE-190', 'proven_safe', None),
    ]),
    "gate_decision": values('path, action, n_sites, n_findings, n_proved', [
        ('array.c', 'allow', 1, 0, 0),
        ('both.c', 'block', 2, 2, 2),
        ('copies.c', 'block', 1, 1, 1),
        ('file.py', 'allow', 2, 0, 0),
        ('fixed.c', 'allow', 1, 0, 0),
        ('grow.c', 'block', 1, 1, 1),
        ('less.c', 'block', 1, 1, 1),
        ('login.py', 'allow', 1, 0, 0),
        ('loose.c', 'warn', 1, 1, 0),
        ('opaque.c', 'warn', 1, 1, 0),
        ('print.c', 'allow', 3, 0, 0),
        ('product.c', 'block', 1, 1, 1),
        ('room.rs', 'block', 1, 1, 1),
        ('share.c', 'block', 1, 1, 1),
        ('shell.py', 'allow', 2, 0, 0),
        ('shifted.c', 'block', 1, 1, 1),
        ('state.py', 'allow', 2, 0, 0),
        ('sum.c', 'allow', 0, 0, 0),
        ('unit.c', 'allow', 1, 1, 1),
    ]),
    "secret_scan": r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:password|passwd|api[_-]?key|secret|token)\s*[:=]\s*["''][^"'']{8,}["'']'))::INTEGER AS n FROM documents WHERE regexp_matches(text, '(?i)(?:password|passwd|api[_-]?key|secret|token)\s*[:=]\s*["''][^"'']{8,}["'']')""",
}
