"""Business records from delimited text with free headers.

Header names are normalised and resolved through ordered aliases; the first
value that isn't empty counts. Rows are validated by expressions and split into
records and errors. White space alone counts as empty. A row number is the
position among non-empty lines, the header being 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.urls import is_email, is_url
from quillon.operators.cuts import cut
from quillon.sources import records

# Accepted header names by field, in order of preference.
ALIASES = {
    "name": ["name", "nombre", "business_name", "negocio"],
    "category": ["category", "categoria", "categoría"],
    "sector": ["sector", "industry", "sector_actividad"],
    "address": ["address", "direccion", "dirección"],
    "city": ["city", "ciudad", "localidad"],
    "region": ["region", "región", "provincia", "state"],
    "postal_code": ["postal_code", "codigo_postal", "código_postal", "cp", "zip"],
    "country": ["country", "pais", "país"],
    "phone": ["phone", "telefono", "teléfono", "tel"],
    "website_url": ["website", "website_url", "web", "url", "sitio_web"],
    "email": ["email", "correo", "e-mail"],
    "gbp_place_id": ["gbp_place_id", "place_id", "google_place_id"],
    "rating": ["rating", "valoracion", "valoración"],
    "review_count": ["review_count", "reviews", "num_resenas", "numero_resenas", "número_reseñas"],
    "latitude": ["latitude", "lat", "latitud"],
    "longitude": ["longitude", "lng", "lon", "longitud"],
}
# Limits of an import, and wording of its errors.
MOST_BYTES, MOST_ROWS = 2 * 1024 * 1024, 2000
NO_NAME, BAD_URL, BAD_EMAIL = "El nombre del negocio es obligatorio", "URL de web no válida", "Email no válido"

#: Numbers: least, most, whole.
RANGES = {"rating": (0, 5, False), "review_count": (0, None, True), "latitude": (-90, 90, False), "longitude": (-180, 180, False)}
ORDINAL, CORRUPT = "__ordinal", "__corrupt"


class ImportLimitError(ValueError):
    """The file or the number of its records is over the limit."""


def header(name: str) -> str:
    return "_".join(name.strip().lower().split())


def delimiter(first_line: str) -> str:
    """Of comma, tab, bar and semicolon the most frequent in the header."""
    return max([",", "\t", "|", ";"], key=first_line.count)


def read_csv(spark: SparkSession, path: str, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """All columns as text under their own names, with the number of each row and the text of malformed ones.

    ``path`` is a file or a folder of files with the same header; their rows are numbered on in
    the order of the files' names. Ranges of a file are read beside each other, also where
    quoted fields have line ends. Of a field that spans lines the ends become a line feed.
    """
    lines = spark.read.text(path)
    if most_bytes is not None:
        size = lines.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("n")).first()["n"]
        if size > most_bytes:
            raise ImportLimitError(f"{size} bytes; {most_bytes} are allowed")
    first = lines.where(F.trim("value") != "").first()
    if first is None:
        return spark.createDataFrame([], T.StructType([T.StructField(ORDINAL, T.LongType()), T.StructField(CORRUPT, T.StringType())]))
    sep = delimiter(first["value"])
    names = spark.createDataFrame([(first["value"].lstrip("\ufeff"),)], "value string").select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(first["value"].count(sep) + 1)), {"sep": sep}).alias("h")).first()["h"]
    taken: dict[str, int] = {}
    columns = []
    for i, n in enumerate(names):
        n = n or f"_c{i}"
        taken[n] = taken.get(n, 0) + 1
        columns.append(n if taken[n] == 1 else f"{n}_{taken[n] - 1}")
    own = records.records(spark, path, sep)
    heads = own.where("n = 0").select(F.regexp_replace("value", "^\ufeff", "").alias("value")).distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError("the files have different headers")
    kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, CORRUPT])
    fields = F.from_csv("value", kinds, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"'})
    # Rows are asked for several times, as records, as errors and for counts.
    return cut(own.where("n > 0").select(F.col("n").alias(ORDINAL), fields.alias("f")).select(ORDINAL, "f.*"))


def resolved(raw: DataFrame) -> DataFrame:
    """Fields by alias, with the number of the row; a field without a column is null."""
    own = {}
    for c in raw.columns:
        own.setdefault(header(c), c)
    field = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    out = []
    for name, aliases in ALIASES.items():
        found = [field(own[a]) for a in aliases if a in own]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    ordinal = F.col(ORDINAL) if ORDINAL in raw.columns else F.monotonically_increasing_id() + 1
    corrupt = F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string")
    return raw.select((ordinal + 1).alias("row"), *out, corrupt.alias(CORRUPT))


def problems() -> Column:
    """Messages of a resolved row, in the order of its fields."""
    found = [F.when(F.col("name").isNull(), NO_NAME), F.when(~is_url(F.col("website_url")), BAD_URL), F.when(~is_email(F.col("email")), BAD_EMAIL)]
    for name, (least, most, whole) in RANGES.items():
        n = F.col(name).try_cast("double")
        bad = n.isNull() | (n < least)
        if most is not None:
            bad = bad | (n > most)
        if whole:
            bad = bad | (n != F.floor(n))
        found.append(F.when(F.col(name).isNotNull() & bad, f"{name}: valor no válido"))
    return F.array_compact(F.array(*found))


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (with their row number) and errors (row, message) of resolved rows."""
    checked = rows.withColumn("__problems", problems())
    good = checked.where(F.size("__problems") == 0)
    texts = [n for n in ALIASES if n not in RANGES]
    whole = F.col("review_count").try_cast("double").cast("int").alias("review_count")
    numbers = [F.col("rating").try_cast("double").alias("rating"), whole, F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude")]
    records = good.select("row", *texts, *numbers, F.lit("csv_import").alias("source"))
    bad = checked.where(F.size("__problems") > 0).select("row", F.array_join("__problems", "; ").alias("message"))
    parse = checked.where(F.col(CORRUPT).isNotNull()).select("row", F.lit("Número de campos no válido").alias("message"))
    return records, bad.unionByName(parse)


def import_text(spark: SparkSession, path: str, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Records and errors of a file, or an error if it has more valid records than allowed."""
    records, errors = validated(resolved(read_csv(spark, path)))
    if records.limit(most_rows + 1).count() > most_rows:
        raise ImportLimitError(f"more than {most_rows} records")
    return records, errors
