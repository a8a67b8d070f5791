"""CSV export in the fixed 18-column form."""

from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import csv_quote


def iso_utc(c):
    """ISO-8601 with offset; microseconds only when they are not zero."""
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(c) % 1_000_000
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(base, frac, F.lit("+00:00"))


def csv_lines(postings):
    """(line_no, line): the header as line -1, then one line per posting numbered by arrival."""
    cells = []
    for name, quoted in vocab.CSV_COLUMNS:
        c = F.array_join("skills", "|") if name == "skills" else F.col(name)
        if name in ("posted_at", "scraped_at"):
            c = iso_utc(c)
        cells.append(csv_quote(c) if quoted else F.coalesce(c, F.lit("")))
    rows = postings.select(F.col("arrival").alias("line_no"), F.concat_ws(",", *cells).alias("line"))
    spark = postings.sparkSession
    header = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("line_no"),
        F.lit(",".join(n for n, _ in vocab.CSV_COLUMNS)).alias("line"))
    return header.unionByName(rows)


def write_csv(postings, path):
    """Text files that, read in part order, are the export."""
    csv_lines(postings).orderBy("line_no").select("line").write.mode("errorifexists").text(path)
