"""Readers and writers of the formats in which networks, places and results come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, attributes) and edges (source, target, attributes) of a GraphML file.

    Attributes are maps from attribute name to text; a missing one is absent. The XML reader splits files.
    """
    def read(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)

    keys = {r["_id"]: r["_attr.name"] for r in read("key", "_id string, `_attr.name` string").collect()}
    names = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]) if keys else F.create_map().cast("map<string,string>")
    data = "data array<struct<_VALUE: string, _key: string>>"
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(F.coalesce(F.element_at(names, d["_key"]), d["_key"]), d["_VALUE"])))
    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("node_id"), attributes.alias("attributes"))
    edges = read("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("source"), F.col("_target").alias("target"), attributes.alias("attributes"))
    return nodes, edges


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a collection: properties (with a declared schema), geometry type and coordinates as JSON text."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def strict_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with one type for each column, decided by its whole text: long, double, boolean or string.

    Empty cells are null. A column with numbers and other text is refused, as is a ragged file.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    tests = {"long": r"^[+-]?\d+$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "boolean": r"^(True|False|true|false)$"}
    all_, any_ = (F.bool_and, F.bool_or)
    aggs = [f(F.col(f"`{c}`").rlike(p)).alias(f"{c}|{k}|{n}") for c in raw.columns for k, p in tests.items() for n, f in (("all", all_), ("any", any_))]
    facts = raw.agg(*aggs).first().asDict()
    out = []
    for c in raw.columns:
        kind = next((k for k in tests if facts[f"{c}|{k}|all"]), "string")
        if kind == "string" and facts[f"{c}|double|any"]:
            raise ValueError(f"column {c} mixes numbers and text")
        out.append(F.col(f"`{c}`").cast(kind).alias(c))
    return raw.select(out)


def coded_csv(spark: SparkSession, path: str, codes: list[str], order: list[str] | None = None) -> DataFrame:
    """CSV, gzipped or not, with inferred types but for ``codes``, which stay text as written (leading zeros and all)."""
    kinds = spark.read.option("header", True).option("inferSchema", True).csv(path)
    text = spark.read.option("header", True).csv(path)
    lost = [c for c in codes if c not in text.columns]
    if lost:
        raise ValueError(f"no column {lost}")
    out = text.select([F.col(f"`{c}`") if c in codes else F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.dtypes])
    return out.orderBy(*order) if order else out


def districts(spark: SparkSession, path: str, properties: str, flag: str, expected: int, order: str) -> DataFrame:
    """The features whose ``flag`` is set, as many as expected, in order."""
    out = geojson(spark, path, properties).where(F.col(flag)).orderBy(order)
    n = out.count()
    if n != expected:
        raise ValueError(f"{n} features are set by {flag}, expected {expected}")
    return out


def network_tables(nodes: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", length: str = "length") -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y) and directed records (u, v, cost, wkt) of ``graphml``; a missing length is null, a missing line too."""
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    n = nodes.select(F.col("node_id").cast("long").alias("node_id"), at(x).cast("double").alias("x"), at(y).cast("double").alias("y"))
    e = edges.select(F.col("source").cast("long").alias("u"), F.col("target").cast("long").alias("v"), F.try_to_number(at(length), F.lit("9999999999.999999999")).cast("double").alias("cost"), at("geometry").alias("wkt"))
    return n, e


def grids_differ(metadata: DataFrame, name: str = "name") -> DataFrame:
    """(column, values) of the metadata that rasters do not share (all columns but ``name``); no row where grids are the same."""
    rest = [c for c in metadata.columns if c != name]
    n = metadata.agg(*[F.size(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("\x00")))).alias(c) for c in rest])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in rest])).alias("r")).select("r.*").where("values > 1")


def tagged_elements(raw: DataFrame, column: str, tags: str = "map<string,string>") -> DataFrame:
    """JSON elements {type, id, lat, lon, center, tags} to rows, one for each (type, id); those without a place go."""
    schema = f"elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: {tags}>>"
    e = raw.select(F.explode(F.from_json(column, schema)["elements"]).alias("e")).select("e.*")
    e = e.select("type", "id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "tags").where("lat IS NOT NULL AND lon IS NOT NULL")
    # of differing rows of an element the first by place, then by its tags as text
    first = e.groupBy("type", "id").agg(F.min_by(F.struct("lat", "lon", "tags"), F.struct("lat", "lon", F.to_json("tags"))).alias("e"))
    return first.select("type", "id", "e.*")


def fixed_precision(df: DataFrame) -> DataFrame:
    """Doubles as text: nine decimals for *_pct, else six; integers bare. For sinks that must be stable."""
    out = [F.format_string("%.9f" if c.endswith("_pct") else "%.6f", F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(out)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Small results: one file in a stable order, LF line ends."""
    fixed_precision(df.orderBy(*order)).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def canonical_json(df: DataFrame, order: list[str], limit: int = 100_000) -> str:
    """A small result as JSON text: keys sorted, NaN and infinity refused, refused beyond ``limit`` rows."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n"


def web_json(df: DataFrame) -> DataFrame:
    """Rows as compact JSON, one text a row, fields in order; NaN and infinity become null."""
    out = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("json"))


def features(df: DataFrame, points: str, kind: str, role: str | None = None, digits: int = 5) -> DataFrame:
    """Rows as GeoJSON features, one JSON text a row: ``points`` is an array of (x, y), ``kind`` Point, LineString or Polygon.

    Coordinates are rounded and repeats that this makes dropped; a polygon's ring is closed. ``role`` is added as a property for display.
    """
    p = F.transform(points, lambda q: F.array(F.round(q["x"], digits), F.round(q["y"], digits)))
    p = F.filter(p, lambda q, i: (i == 0) | (q != F.get(p, i - 1)))
    ring = F.when(F.element_at(p, 1) == F.element_at(p, -1), p).otherwise(F.concat(p, F.slice(p, 1, 1)))
    shape = {"Point": F.element_at(p, 1), "LineString": p, "Polygon": F.array(ring)}[kind]
    props = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes if c != points]
    props += [F.lit(role).alias("display_role")] if role else []
    geometry = F.struct(F.lit(kind).alias("type"), shape.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("feature"))


def collection(rows: DataFrame, provenance: dict | None = None, limit: int = 100_000) -> str:
    """Features (one text a row) as one collection's text, with a provenance member; refused beyond ``limit`` features."""
    got = [r[0] for r in rows.limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"more than {limit} features")
    extra = f'"provenance":{json.dumps(provenance, sort_keys=True, ensure_ascii=False)},' if provenance else ""
    return '{"type":"FeatureCollection",' + extra + '"features":[' + ",".join(sorted(got)) + "]}\n"


def write_gzip_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """As ``write_csv``, gzipped."""
    fixed_precision(df.orderBy(*order)).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("compression", "gzip").csv(path)


def write_cells(df: DataFrame, path: str, key: str = "cell_id") -> None:
    """The cell cache: sorted within files by key, keys unique (refused otherwise)."""
    again = df.groupBy(key).count().where("count > 1 OR " + key + " IS NULL").limit(3).collect()
    if again:
        raise ValueError(f"{key} repeats or is null: {[r[0] for r in again]}")
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str, need: list[str], key: str = "cell_id") -> DataFrame:
    """The cell cache, with the columns that a reader needs and without null or NaN in them (refused otherwise)."""
    df = spark.read.parquet(path)
    lost = [c for c in need if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks {lost}")
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in need if dict(df.dtypes)[c] in ("double", "float", "int", "bigint")]
    wrong = {k: n for k, n in df.agg(*bad).first().asDict().items() if n} if bad else {}
    if wrong:
        raise ValueError(f"{path} has null or NaN: {wrong}")
    return df


def content_digest(df: DataFrame, order: list[str]) -> str:
    """SHA-256 of a small table's canonical JSON: equal content, equal digest, whatever the files."""
    import hashlib

    return hashlib.sha256(canonical_json(df, order).encode("utf-8")).hexdigest()


def feature_collection(df: DataFrame, x: str, y: str, digits: int = 5) -> DataFrame:
    """Points as GeoJSON features, one JSON text a row; NaN becomes null."""
    props = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(x, digits), F.round(y, digits)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))
