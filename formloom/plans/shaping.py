"""Queries p1, p2, p4 and p5: nested pages, dangling references, drifting schemas, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.catalog import spread, table
from formloom.operators import drift, nested, orphans, packed

#: Canonical fields of a result record and their types.
RECORD_SCHEMA = {
    "qid": "string", "seq": "bigint", "text": "string", "annotation": "string", "domain": "string", "pattern": "string",
    "confidence": "double", "valid": "boolean", "page_id": "bigint", "form": "string", "section": "string",
    "question_annotation": "string", "option_annotations": drift.JSON,
}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Options and question annotations of all nested pages."""
    return nested.flatten_options(spread(table(spark, root, "page_results").select("result_id", "payload")))


def _references(spark: SparkSession, root: str):
    pa, ct = table(spark, root, "page_annotations"), table(spark, root, "ct_relationships")
    codes = F.regexp_extract_all(F.upper("domain"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    refs = (
        orphans.references(pa, "page_annotations", "domain", "row_id", codes, "annotated_at")
        .unionByName(orphans.references(ct, "ct_relationships", "variable_name", "rel_id", F.array(orphans.normal_key(F.col("variable_name"))), "created_at", F.col("domain_code")))
        .unionByName(orphans.references(ct, "ct_relationships", "codelist_code", "rel_id", F.array(orphans.normal_key(F.col("codelist_code"))), "created_at"))
    )
    dims = [
        orphans.dimension("domain", table(spark, root, "sdtm_domains"), "domain_code"),
        orphans.dimension("variable_name", table(spark, root, "sdtm_variables"), "var_name", "domain_code"),
        orphans.dimension("codelist_code", table(spark, root, "ct_codelists"), "codelist_code"),
    ]
    return refs, dims


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every reference without a live dictionary row at its time."""
    return orphans.orphan_references(*_references(spark, root))


def p2_orphan_counts(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references per table, field, reason and month."""
    return orphans.orphan_counts(*_references(spark, root))


_P2 = r"""
WITH refs AS (
  SELECT DISTINCT 'page_annotations' AS table_name, row_id, 'domain' AS field_name, k AS ref_key, '' AS scope_key, annotated_at AS t
  FROM (SELECT row_id, annotated_at, unnest(regexp_extract_all(upper(domain), '[\p{L}\p{N}]+')) AS k FROM page_annotations)
  UNION ALL
  SELECT DISTINCT 'ct_relationships', rel_id, 'variable_name', upper(trim(variable_name)), coalesce(upper(trim(domain_code)), ''), created_at
  FROM ct_relationships WHERE trim(variable_name) <> ''
  UNION ALL
  SELECT DISTINCT 'ct_relationships', rel_id, 'codelist_code', upper(trim(codelist_code)), '', created_at
  FROM ct_relationships WHERE trim(codelist_code) <> ''),
dims AS (
  SELECT 'domain' AS field_name, upper(trim(domain_code)) AS ref_key, '' AS scope_key, loaded_at, deleted_at FROM sdtm_domains
  UNION ALL SELECT 'variable_name', upper(trim(var_name)), coalesce(upper(trim(domain_code)), ''), loaded_at, deleted_at FROM sdtm_variables
  UNION ALL SELECT 'codelist_code', upper(trim(codelist_code)), '', loaded_at, deleted_at FROM ct_codelists),
judged AS (
  SELECT r.table_name, r.row_id, r.field_name, r.ref_key, r.t,
         coalesce(bool_or(d.loaded_at <= r.t AND (d.deleted_at IS NULL OR d.deleted_at > r.t)), false) AS live,
         min(d.loaded_at) AS first_load
  FROM refs r LEFT JOIN dims d USING (field_name, ref_key, scope_key)
  WHERE r.t IS NOT NULL GROUP BY ALL),
found AS (
  SELECT table_name, row_id, field_name, ref_key,
         CASE WHEN first_load IS NULL THEN 'missing' WHEN first_load > t THEN 'late' ELSE 'deleted' END AS reason,
         strftime(t, '%Y-%m') AS ref_month
  FROM judged WHERE NOT live)
"""


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Changes of each delivered file against the study's file before it."""
    return drift.schema_changes(table(spark, root, "result_lines")).select("file_id", "field_name", "change_kind")


def p4_path_stats(spark: SparkSession, root: str) -> DataFrame:
    """Path and type statistics of each file."""
    stats = drift.path_statistics(table(spark, root, "result_lines"), "study_id", "file_id", "delivered_at", "line_text")
    return stats.select(F.col("file").alias("file_id"), "field_name", "n_records", "n_typed", "json_type")


def p4_records(spark: SparkSession, root: str) -> DataFrame:
    """All whole records in one typed table; failed_casts tells how many cells would not cast, and rest
    holds every other field."""
    lines = table(spark, root, "result_lines")
    names = drift.file_names(lines, drift.schema_changes(lines), RECORD_SCHEMA)
    return drift.unify(lines, RECORD_SCHEMA, names).withColumn("failed_casts", F.size("failed_casts"))


def p4_failed_casts(spark: SparkSession, root: str) -> DataFrame:
    """Cells whose cast to the field's type failed, by field, raw type and file."""
    lines = table(spark, root, "result_lines")
    names = drift.file_names(lines, drift.schema_changes(lines), RECORD_SCHEMA)
    cells = drift.unify(lines, RECORD_SCHEMA, names).select("file_id", F.explode_outer("failed_casts").alias("c")).filter("c IS NOT NULL")
    return cells.groupBy("file_id", F.col("c.field").alias("field_name"), F.col("c.json_type").alias("json_type")).agg(F.count(F.lit(1)).alias("n_cells"))


def p4_own_records(spark: SparkSession, root: str) -> DataFrame:
    """All whole records by the fields' own names, without renames: typed columns, and how many cells would not
    cast or have no column."""
    rows = drift.unify(table(spark, root, "result_lines"), RECORD_SCHEMA, {})
    return rows.select("line_id", "file_id", *[c for c in RECORD_SCHEMA if RECORD_SCHEMA[c] != drift.JSON], F.size("failed_casts").alias("n_failed"), F.size("rest").alias("n_rest"))


def p4_own_failed_casts(spark: SparkSession, root: str) -> DataFrame:
    """Cells under a field's own name that would not cast, by file, field and raw type."""
    cells = drift.unify(table(spark, root, "result_lines"), RECORD_SCHEMA, {}).select("file_id", F.explode_outer("failed_casts").alias("c")).filter("c IS NOT NULL")
    return cells.groupBy("file_id", F.col("c.field").alias("field_name"), F.col("c.json_type").alias("json_type")).agg(F.count(F.lit(1)).alias("n_cells"))


_P4_JSON = """WITH l AS (SELECT line_id, file_id, CASE WHEN json_valid(line_text) THEN line_text::JSON END AS j FROM result_lines),
o AS (SELECT line_id, file_id, j FROM l WHERE j IS NOT NULL AND json_type(j) = 'OBJECT')"""
_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _own_cell(name: str) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN TRY_CAST(json_extract_string(j, '$.{name}') AS {_SQL_TYPES[RECORD_SCHEMA[name]]}) END"


def _cell_failed(name: str) -> str:
    return f"coalesce(json_type(j, '$.{name}') <> 'NULL', false) AND {_own_cell(name)} IS NULL"


_OWN = [c for c in RECORD_SCHEMA if RECORD_SCHEMA[c] != drift.JSON]
_P4_OWN = f"""{_P4_JSON} SELECT line_id, file_id, {", ".join(f"{_own_cell(c)} AS {c}" for c in _OWN)},
 {" + ".join(f"CAST({_cell_failed(c)} AS INTEGER)" for c in _OWN)} AS n_failed,
 len(list_filter(json_keys(j), lambda k: k NOT IN ({", ".join(f"'{c}'" for c in RECORD_SCHEMA)}))) AS n_rest FROM o"""
_P4_OWN_FAILED = f"""{_P4_JSON}, c AS ({" UNION ALL ".join(f"SELECT file_id, '{c}' AS field_name, json_type(j, '$.{c}') AS t FROM o WHERE {_cell_failed(c)}" for c in _OWN)})
SELECT file_id, field_name, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS json_type, count(*) AS n_cells FROM c GROUP BY ALL"""


_P4_STATS = """
WITH l AS (SELECT file_id, CASE WHEN json_valid(line_text) THEN line_text::JSON END AS j FROM result_lines),
o AS (SELECT file_id, j FROM l WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
k AS (SELECT file_id, j, unnest(json_keys(j)) AS field_name FROM o),
c AS (SELECT file_id, field_name, CASE json_type(json_extract(j, '$."' || field_name || '"'))
        WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object'
        WHEN 'NULL' THEN NULL ELSE 'number' END AS t FROM k),
n AS (SELECT file_id, field_name, t, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, field_name ORDER BY t IS NULL, n DESC,
        CASE t WHEN 'string' THEN 0 WHEN 'number' THEN 1 WHEN 'boolean' THEN 2 WHEN 'array' THEN 3 ELSE 4 END) AS rn FROM n)
SELECT file_id, field_name, CAST(sum(n) AS BIGINT) AS n_records,
       CAST(coalesce(sum(n) FILTER (WHERE t IS NOT NULL), 0) AS BIGINT) AS n_typed, max(t) FILTER (WHERE rn = 1) AS json_type
FROM r GROUP BY file_id, field_name
"""


def packed_sql(field: str) -> str:
    """The values packed in a text, as a list. Delimiters of quoted spans stand as private-use characters
    meanwhile. Letters take apostrophes right after them along, so those open no span."""
    hidden, signs = "chr(57345)||chr(57346)||chr(57347)||chr(57348)||chr(57349)||chr(57350)||chr(57351)", "',;|/'||chr(9)||chr(13)||chr(10)"
    double, curly = '"[^"]*(?:""[^"]*)*"', "“[^”]*”"
    single = r"'(?:[^']*[\p{L}\p{N}]'[\p{L}\p{N}]|[^']*'')*[^']*'".replace("'", "''")
    span = f"{double}|{curly}|{single}"
    token = span + r"|[\p{L}\p{N}]+''*|[\s\S]"
    pieces = f"list_transform(regexp_extract_all(coalesce({field}, ''), '{token}'), lambda x: CASE WHEN regexp_full_match(x, '{span}') THEN translate(x, {signs}, {hidden}) ELSE x END)"
    slashed = f"array_to_string({pieces}, '')"
    for _ in range(2):
        slashed = rf"regexp_replace({slashed}, '(^|\s)/(\s|$)', '\1;\2', 'g')"
    trim = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    parts = rf"list_transform(string_split_regex({slashed}, '[,;|\t\r\n\x0b\f]'), lambda x: {trim.format('x')})"
    inner = "x[2:-2]"
    bare = f"""list_transform({parts}, lambda x: CASE WHEN regexp_full_match(x, '{double}') THEN replace({inner}, '""', '"')
      WHEN regexp_full_match(x, '{single}') THEN replace({inner}, '''''', '''') WHEN regexp_full_match(x, '{curly}') THEN {inner} ELSE x END)"""
    return f"list_filter(list_transform({bare}, lambda x: {trim.format(f'translate(x, {hidden}, {signs})')}), lambda x: x <> '')"


_P5 = " UNION ALL ".join(
    f"SELECT row_id, '{f}' AS field_name, CAST(generate_subscripts(v, 1) AS INTEGER) AS pos, unnest(v) AS part_value FROM (SELECT row_id, {packed_sql(f)} AS v FROM page_annotations) WHERE len(v) >= 2"
    for f in ("annotation", "option_annotations")
)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Each value of the packed annotation fields, with its position."""
    return packed.explode_packed(spread(table(spark, root, "page_annotations").select("row_id", "annotation", "option_annotations")), "row_id", ["annotation", "option_annotations"])


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_orphan_counts": p2_orphan_counts,
    "p4_found": p4_found,
    "p4_path_stats": p4_path_stats,
    "p4_records": p4_records,
    "p4_failed_casts": p4_failed_casts,
    "p4_own_records": p4_own_records,
    "p4_own_failed_casts": p4_own_failed_casts,
    "p5_found": p5_found,
}

ORACLES = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_orphan_counts": _P2
    + "SELECT table_name, field_name, reason, ref_month, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY ALL",
    "p4_path_stats": _P4_STATS,
    "p4_own_records": _P4_OWN,
    "p4_own_failed_casts": _P4_OWN_FAILED,
    "p5_found": _P5,
}
