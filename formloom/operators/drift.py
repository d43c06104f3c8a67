"""Schemas that drift between the files of a source.

Every line is parsed once into a path-value map that keeps each value with its raw JSON type. Path
and type statistics are aggregated per file, consecutive files of a source are compared, and the
records are projected onto typed columns with a report of each cell whose cast failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import materialise

_BUCKETS = 4096
_TYPES = ["string", "number", "boolean", "array", "object"]


def type_name(schema: Column) -> Column:
    """JSON type by the schema text of a variant: string, number, boolean, array, object; null for JSON null."""
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema == "VOID", F.lit(None).cast("string"))
        .otherwise("number")
    )


def cells(lines: DataFrame, line_col: str, keep: list[str], names: DataFrame | None = None) -> DataFrame:
    """keep columns plus (field_name, raw, json_type): one row for each top-level field of each
    whole record, of those in ``names`` (field_name) if given. Lines that are no JSON object (broken
    off, blank, null) give none; null values are kept with a null type."""
    parsed = lines.select(*keep, F.try_parse_json(F.col(line_col)).alias("_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    exploded = lines.sparkSession.sql(
        f"SELECT {', '.join('p.`' + k + '`' for k in keep)}, e.key AS field_name, e.value AS _value FROM {{p}} p, LATERAL variant_explode(p._v) e",
        p=parsed,
    )
    if names is not None:
        exploded = exploded.join(names, "field_name", "left_semi")
    # The schema is taken once; the type looks at it several times.
    told = exploded.select(*keep, "field_name", F.schema_of_variant("_value").alias("_s"), F.col("_value").cast("string").alias("raw"))
    return told.select(*keep, "field_name", type_name(F.col("_s")).alias("json_type"), "raw")


def _file_fields(lines: DataFrame, source: str, file: str, time: str, line_col: str) -> DataFrame:
    """As ``path_statistics``, with a row of a null field_name for each file that has lines without fields, so
    that files without any whole record stand here too. One pass, pre-aggregated where the lines are."""
    v = F.try_parse_json(F.col(line_col))
    parsed = lines.select(F.col(source).alias("source"), F.col(file).alias("file"), F.col(time).alias("_time"), v.alias("_p"))
    parsed = parsed.withColumn("_v", F.when(F.schema_of_variant("_p").startswith("OBJECT"), F.col("_p"))).drop("_p")
    exploded = lines.sparkSession.sql("SELECT p.source, p.file, p._time, e.key AS field_name, e.value AS _value FROM {p} p, LATERAL variant_explode_outer(p._v) e", p=parsed)
    told = exploded.select("source", "file", "_time", "field_name", F.schema_of_variant("_value").alias("_s"))
    c = told.withColumn("json_type", F.when(F.col("field_name").isNotNull(), type_name(F.col("_s"))))
    counts = [F.sum((F.col("json_type") == t).cast("long")) for t in _TYPES]
    typed = F.array(*[F.struct(F.coalesce(n, F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, n) in enumerate(zip(_TYPES, counts))])
    return c.groupBy("source", "file", "field_name").agg(
        F.min("_time").alias("file_time"),
        F.count(F.lit(1)).alias("n_records"),
        F.count("json_type").alias("n_typed"),
        F.array_max(typed).alias("_top"),
    ).select("source", "file", "file_time", "field_name", "n_records", "n_typed", F.when(F.col("_top.n") > 0, F.col("_top.t")).alias("json_type"))


def path_statistics(lines: DataFrame, source: str, file: str, time: str, line_col: str) -> DataFrame:
    """(source, file, time, field_name, n_records, n_typed, json_type): for each field of each file
    the records that have it, those where it is not null, and its prevailing type (by count, then
    name; null where all values are null)."""
    return _file_fields(lines, source, file, time, line_col).filter(F.col("field_name").isNotNull())


def _file_order(files: DataFrame) -> DataFrame:
    """Each file with the file of its source before it, by (time, file); files without any whole
    record count. A null time sorts first. ``files`` has source, file, file_time in any number of rows a file."""
    files = files.groupBy("source", "file").agg(F.min("file_time").alias("file_time"))
    w = Window.partitionBy("source").orderBy(F.col("file_time").asc_nulls_first(), F.col("file").asc_nulls_first())
    return files.withColumn("prev_file", F.lag("file").over(w)).withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") > 1).select("source", "file", "prev_file")


def _shape(c: Column) -> Column:
    for pattern, by in (("[0-9]+(?:[.][0-9]+)?", "9"), (r"\p{Ll}+", "a"), (r"\p{Lu}", "A")):
        c = F.regexp_replace(c, pattern, by)
    return c


def _features(c: DataFrame, by: list[str]) -> DataFrame:
    """Counts of word and shape features of the values, hashed to a fixed number of buckets.
    The names of an object's keys and its values both count as content."""
    words = F.transform(F.regexp_extract_all("raw", F.lit(r"(\p{L}+|[0-9]+(?:[.][0-9]+)?)"), F.lit(1)), lambda t: F.concat(F.lit("w:"), t))
    shapes = F.array(F.concat(F.lit("s:"), _shape(F.col("raw"))))
    feats = c.filter(F.col("json_type").isNotNull()).select(*by, F.explode(F.concat(words, shapes)).alias("_f"))
    return feats.select(*by, F.substring("_f", 1, 1).alias("kind"), F.pmod(F.xxhash64("_f"), F.lit(_BUCKETS)).cast("int").alias("bucket")).groupBy(*by, "kind", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _cosine(pairs: DataFrame, a: DataFrame, a_keys: list[str], b: DataFrame, b_keys: list[str], pair_keys: list[str]) -> DataFrame:
    """pair_keys, kind, cos of the feature counts of the pair's two sides."""
    norm_a = a.groupBy(*a_keys, "kind").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_na"))
    norm_b = b.groupBy(*b_keys, "kind").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_nb"))
    dot = pairs.join(a, a_keys).withColumnRenamed("n", "_n").join(b, [*b_keys, "kind", "bucket"]).groupBy(*pair_keys, "kind").agg(F.sum(F.col("_n") * F.col("n")).alias("_dot"))
    return dot.join(norm_a, [*a_keys, "kind"]).join(norm_b, [*b_keys, "kind"]).select(*pair_keys, "kind", (F.col("_dot") / (F.col("_na") * F.col("_nb"))).alias("cos"))


def schema_changes(
    lines: DataFrame,
    source: str = "study_id",
    file: str = "file_id",
    time: str = "delivered_at",
    line_col: str = "line_text",
    least_similarity: float = 0.45,
) -> DataFrame:
    """(file, field_name, change_kind, old_name, old_type, new_type, similarity) of each change of
    each file against the file before it: added, removed, renamed, retyped.

    A rename is a removed and an added field of one file pair, of the same JSON type, whose
    contents agree: half the score is the agreement of the two files' values, half that of all
    values ever seen under the two names; each part is the mean of a word and a shape cosine.
    Pairs are taken best first, and a field enters at most one. Null is no type; a field that is
    null throughout is present but not retyped. Null sources form one source. Empty tables give
    an empty result.
    """
    fields = materialise(_file_fields(lines, source, file, time, line_col), "path-stats")
    stats, order = fields.filter(F.col("field_name").isNotNull()), _file_order(fields)
    now = stats.select("file", "field_name", F.col("json_type").alias("new_type"))
    old = order.join(stats.select(F.col("file").alias("prev_file"), "field_name", F.col("json_type").alias("old_type")), "prev_file").select("source", "file", "prev_file", "field_name", "old_type", F.lit(True).alias("_o"))
    new = order.join(now, "file").select("source", "file", "prev_file", "field_name", "new_type", F.lit(True).alias("_n"))
    both = old.join(new.drop("source", "prev_file"), ["file", "field_name"], "full")
    both = both.drop("source", "prev_file").join(order, "file")
    diff = materialise(
        both.withColumn(
            "change_kind",
            F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped"),
        ).filter(F.col("change_kind").isNotNull()).select("source", "file", "prev_file", "field_name", "change_kind", "old_type", "new_type"),
        "schema-diff",
    )
    gone = diff.filter("change_kind = 'removed'").select("file", "prev_file", F.col("field_name").alias("old_name"), "old_type")
    come = diff.filter("change_kind = 'added'").select("file", F.col("field_name").alias("new_name"), "new_type")
    pairs = gone.join(come, "file").filter(F.col("old_type") == F.col("new_type"))

    # Small tables are written first, so that Spark knows their size and broadcasts them where its limit allows.
    pairs = materialise(pairs, "rename-pairs")
    names = materialise(pairs.select(F.explode(F.array("old_name", "new_name")).alias("field_name")).distinct(), "rename-names")
    ends = F.explode(F.array(F.struct(F.col("prev_file").alias("file"), F.col("old_name").alias("field_name")), F.struct(F.col("file").alias("file"), F.col("new_name").alias("field_name"))))
    sides = materialise(pairs.select(ends.alias("_e")).select("_e.*").distinct().withColumn("_side", F.lit(True)), "rename-sides")
    wanted = cells(lines.withColumnRenamed(file, "file"), line_col, ["file"], names).join(sides, ["file", "field_name"], "left")
    # One pass: the files of a pair stand for themselves, all others of a name together.
    feats = materialise(_features(wanted.withColumn("file", F.when(F.col("_side"), F.col("file"))).withColumn("_side", F.coalesce("_side", F.lit(False))), ["_side", "file", "field_name"]), "rename-features")
    by_file = feats.filter("_side").drop("_side")
    by_name = feats.groupBy("field_name", "kind", "bucket").agg(F.sum("n").alias("n"))

    keys = ["file", "prev_file", "old_name", "new_name"]
    fa = by_file.withColumnsRenamed({"file": "prev_file", "field_name": "old_name"})
    fb = by_file.withColumnRenamed("field_name", "new_name")
    local = _cosine(pairs.select(keys), fa, ["prev_file", "old_name"], fb, ["file", "new_name"], keys)
    ga, gb = by_name.withColumnRenamed("field_name", "old_name"), by_name.withColumnRenamed("field_name", "new_name")
    name_pairs = pairs.select("old_name", "new_name").distinct()
    world = _cosine(name_pairs, ga, ["old_name"], gb, ["new_name"], ["old_name", "new_name"])
    local = local.groupBy(*keys).agg(F.sum("cos").alias("_lc"))
    world = world.groupBy("old_name", "new_name").agg(F.sum("cos").alias("_wc"))
    scored = (
        pairs.join(local, keys, "left").join(world, ["old_name", "new_name"], "left")
        .withColumn("similarity", F.round((F.coalesce("_lc", F.lit(0.0)) + F.coalesce("_wc", F.lit(0.0))) / 4, 6))
        .filter(F.col("similarity") >= least_similarity)
    )
    renamed = _best_first(scored)
    taken_old = renamed.select("file", F.col("old_name").alias("field_name"), F.lit("removed").alias("change_kind"))
    taken_new = renamed.select("file", F.col("new_name").alias("field_name"), F.lit("added").alias("change_kind"))
    rest = diff.join(taken_old.union(taken_new), ["file", "field_name", "change_kind"], "left_anti")
    out = rest.select("file", "field_name", "change_kind", F.lit(None).cast("string").alias("old_name"), "old_type", "new_type", F.lit(None).cast("double").alias("similarity"))
    return out.unionByName(renamed.select("file", F.col("new_name").alias("field_name"), F.lit("renamed").alias("change_kind"), "old_name", "old_type", "new_type", "similarity")).withColumnRenamed("file", file)


def _best_first(scored: DataFrame) -> DataFrame:
    """One-to-one pairs of a file, best score first. Fields of one file are few, so the pairs of
    each file fit an array; a pair is dropped if an earlier kept one shares a name."""
    pair = F.struct((-F.col("similarity")).alias("s"), "old_name", "new_name", "old_type", "new_type", "similarity")
    kept = F.aggregate(
        F.array_sort(F.collect_list(pair)),
        F.array().cast("array<struct<s:double,old_name:string,new_name:string,old_type:string,new_type:string,similarity:double>>"),
        lambda acc, p: F.when(F.exists(acc, lambda k: (k["old_name"] == p["old_name"]) | (k["new_name"] == p["new_name"])), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return scored.groupBy("file").agg(kept.alias("_k")).select("file", F.explode("_k").alias("_p")).select("file", "_p.old_name", "_p.new_name", "_p.old_type", "_p.new_type", "_p.similarity")


def _targets(events: list[tuple], schema: set[str]) -> list[tuple[str, int, int, str]]:
    """(name, first, last, schema field) of the lives of the other names of one source. ``events`` are renames
    (number of the file, old name, new name). A life lasts from the rename that brings a name to the one
    that takes it; lives linked by renames form a chain, and a name stands for the schema field
    nearest before it in its chain, else the nearest after it."""
    chains: list[list[list]] = []
    last, gone = {}, {}
    for nth, old, new in sorted(events):
        chain = last.pop(old, None)
        if chain is None:
            chain = [[old, gone.get(old, 0), 1 << 30]]
            chains.append(chain)
        chain[-1][2] = gone[old] = nth
        if new in last:
            last[new][-1][2] = nth
        chain.append([new, nth, 1 << 30])
        last[new] = chain
    out = []
    for chain in chains:
        for i, (name, first, end) in enumerate(chain):
            to = next((x[0] for x in [*chain[:i][::-1], *chain[i:]] if x[0] in schema), None)
            if name not in schema and to:
                out.append((name, first, end - 1, to))
    return out


def file_names(lines: DataFrame, changes: DataFrame, schema: dict[str, str], source: str = "study_id", file: str = "file_id", time: str = "delivered_at", line_col: str = "line_text") -> DataFrame:
    """(file, field_name, to): the schema field that another name stands for in a file.

    The renames of the file's own source decide, as far as they reach (see ``_targets``). A name without
    any there stands for the field that all other sources agree on, unless the file has that field by
    another name. A schema name always stands for itself, and a name that is left has no row."""
    files = lines.groupBy(F.col(source).alias("source"), F.col(file).alias("file")).agg(F.min(time).alias("_t"))
    w = Window.partitionBy("source").orderBy(F.col("_t").asc_nulls_first(), F.col("file").asc_nulls_first())
    places = materialise(files.select("source", "file", F.row_number().over(w).alias("nth")), "file-places")
    renamed = changes.filter("change_kind = 'renamed'").select(F.col(file).alias("file"), "old_name", F.col("field_name").alias("new_name"))
    own = set(schema)

    @F.udf("array<struct<field_name:string,first:int,last:int,to:string>>")
    def targets(events):
        return _targets([tuple(e) for e in events], own)

    by_source = renamed.join(places, "file").groupBy("source").agg(F.collect_list(F.struct("nth", "old_name", "new_name")).alias("_e"))
    spans = materialise(by_source.select("source", F.explode(targets("_e")).alias("_s")).select("source", "_s.*"), "rename-spans")
    held = cells(lines.select(F.col(file).alias("file"), line_col), line_col, ["file"]).select("file", "field_name").distinct()
    held = materialise(held.join(places, "file"), "file-fields")
    other = held.filter(~F.col("field_name").isin(*own))
    here = other.join(spans.withColumnRenamed("source", "_src"), "field_name").filter(F.col("source").eqNullSafe(F.col("_src")) & F.col("nth").between(F.col("first"), F.col("last"))).select("file", "field_name", "to").distinct()
    here = materialise(here.groupBy("file", "field_name").agg(F.min("to").alias("to")), "own-names")
    agreed = spans.groupBy("field_name").agg(F.min("to").alias("to"), F.max("to").alias("_b")).filter(F.col("to") == F.col("_b")).drop("_b")
    known = spans.select("source", "field_name").distinct().withColumnRenamed("source", "_src")
    foreign = other.join(known, F.col("source").eqNullSafe(F.col("_src")) & (other["field_name"] == known["field_name"]), "left_anti").join(agreed, "field_name").select("file", "field_name", "to")
    there = here.select("file", "to").union(held.filter(F.col("field_name").isin(*own)).select("file", F.col("field_name").alias("to")))
    return here.unionByName(foreign.join(there, ["file", "to"], "left_anti").select("file", "field_name", "to")).withColumnRenamed("file", file)


#: Schema type of fields that may hold any JSON; their text is the value's JSON.
JSON = "json"


def unify(lines: DataFrame, schema: dict[str, str], names: dict[str, str] | DataFrame, line_col: str = "line_text", keep: tuple[str, ...] = ("line_id", "file_id")) -> DataFrame:
    """Typed columns of ``schema`` (canonical name to Spark type, or JSON) for every whole record, plus
    failed_casts: an array of (field, json_type, raw) of values that would not cast, and rest: a map
    from name to (json_type, raw) of all fields that no column was taken from.

    An object or array does not cast to a single value's type; any value casts to JSON, which is a
    string column. ``names`` maps other names to canonical ones, for all lines or, as a table (one
    of ``keep``, field_name, to), for those of a file; where a record holds several, the canonical one
    wins, then the first in name order, and the others are in rest. Schema names are never mapped. Each
    line is parsed once and stays where it is, but for the join with the names of its file, which
    are broadcast where Spark's own size limit allows."""
    if isinstance(names, DataFrame):
        on = [k for k in keep if k in names.columns]
        of_file = materialise(names.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "to"))).alias("_names")), "file-names")
        rows = lines.join(of_file, on, "left")
    else:
        given = [F.lit(x) for n, to in sorted(names.items()) if to in schema and n not in schema for x in (n, to)]
        rows = lines.withColumn("_names", F.create_map(*given) if given else F.lit(None).cast("map<string,string>"))
    parsed = F.try_parse_json(F.col(line_col))
    rows = rows.filter(F.schema_of_variant(parsed).startswith("OBJECT"))
    names_of = F.coalesce("_names", F.create_map().cast("map<string,string>"))
    raw = lambda m, k: F.element_at(m, k)["raw"]

    # Each step is bound to a lambda's argument: as columns of their own, the optimizer would write out
    # every step anew wherever it is used.
    def read(m: Column) -> Column:
        return F.transform_values(m, lambda _, v: F.struct(F.schema_of_variant(v).alias("s"), v.cast("string").alias("raw")))

    def hold(m: Column) -> Column:
        return F.struct(F.transform_values(m, lambda _, x: F.struct(type_name(x["s"]).alias("json_type"), F.when(x["s"] != "VOID", x["raw"]).alias("raw"))).alias("m"), names_of.alias("names"))

    def alias(b: Column) -> Column:
        named = F.transform(F.array_sort(F.map_keys(b["m"])), lambda k: F.struct(k.alias("name"), F.element_at(b["names"], k).alias("to")))
        return F.struct(b["m"].alias("m"), b["names"].alias("names"), F.filter(named, lambda x: x["to"].isNotNull() & ~x["name"].isin(*schema) & raw(b["m"], x["name"]).isNotNull()).alias("known"))

    def choose(b: Column) -> Column:
        source = [F.when(raw(b["m"], F.lit(n)).isNotNull(), F.lit(n)).otherwise(F.get(F.filter(b["known"], lambda x: x["to"] == n), F.lit(0))["name"]) for n in schema]
        return F.struct(b["m"].alias("m"), b["names"].alias("names"), F.array(*source).alias("source"))

    def take(b: Column) -> Column:
        taken = F.transform(b["source"], lambda n: F.struct(n.alias("field"), F.element_at(b["m"], n)["json_type"].alias("json_type"), raw(b["m"], n).alias("raw")))
        mapped = lambda k: k.isin(*schema) | F.element_at(b["names"], k).isNotNull()
        rest = F.map_filter(b["m"], lambda k, x: ~F.array_contains(F.array_compact(b["source"]), k) & (~mapped(k) | x["raw"].isNotNull()))
        return F.struct(taken.alias("taken"), rest.alias("rest"))

    def cast(b: Column) -> Column:
        typed = []
        for i, (name, to) in enumerate(schema.items()):
            x = b["taken"][i]
            typed.append((x["raw"] if to == JSON else F.when(~x["json_type"].isin("object", "array"), x["raw"] if to == "string" else x["raw"].try_cast(to))).alias(name))
        return F.struct(F.struct(*typed).alias("typed"), b["taken"].alias("taken"), b["rest"].alias("rest"))

    def report(b: Column) -> Column:
        failed = [F.when(b["taken"][i]["raw"].isNotNull() & b["typed"][name].isNull(), b["taken"][i]) for i, name in enumerate(schema)]
        return F.struct(b["typed"].alias("typed"), F.array_compact(F.array(*failed)).alias("failed_casts"), b["rest"].alias("rest"))

    chain = F.array(F.try_variant_get(parsed, "$", "map<string,variant>"))
    for step in (read, hold, alias, choose, take, cast, report):
        chain = F.transform(chain, step)
    rows = rows.select(*keep, F.element_at(chain, 1).alias("_r"))
    return rows.select(*keep, *[F.col(f"_r.typed.{n}").alias(n) for n in schema], F.col("_r.failed_casts").alias("failed_casts"), F.col("_r.rest").alias("rest"))
