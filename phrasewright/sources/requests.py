"""Tag requests as rows: (method, url, body) in, (status, response) out.

Routing and checks of the tagging service over a DataFrame, so that a batch or a stream of requests is
tagged by the same plan as any texts. There is no server in here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_lower, blank, json_escape_column, json_string_field, query_param_column
from ..operators import formats
from ..operators.matching import key_names

FORMATS = ("simple", "solr")
#: The bodies of answers without tags.
SAID = {"health": '{"status":"ok"}', "text": '{"error":"provide ?text= (GET) or {\\"text\\":\\"...\\"} (POST)"}', "path": '{"error":"not found"}', "method": '{"error":"method not allowed"}'}


def parse(requests: DataFrame) -> DataFrame:
    """Adds path, text, format (lower case; simple by default), and status and said (both null where the text can be
    tagged, else the answer's status and body).

    GET reads text and format from the query, POST from a JSON body, where the query's format counts first.
    """
    path, query = F.substring_index("url", "?", 1), F.when(F.contains(F.col("url"), F.lit("?")), F.expr("substring(url, instr(url, '?') + 1)")).otherwise("")
    rows = requests.withColumn("path", path).withColumn("_query", query)
    posted = F.col("method") == "POST"
    text = F.when(posted, json_string_field(F.col("body"), "text")).otherwise(query_param_column(F.col("_query"), "text"))
    asked = query_param_column(F.col("_query"), "format")
    shape = F.when(posted, F.coalesce(asked, json_string_field(F.col("body"), "format"))).otherwise(asked)
    rows = rows.withColumn("text", text).withColumn("format", ascii_lower(F.coalesce(shape, F.lit("simple"))))
    unknown = F.concat(F.lit('{"error":"unknown format \''), json_escape_column(F.col("format")), F.lit("' — supported: simple, solr\"}"))
    cases = [
        (~F.col("path").isin("/tag", "/health"), 404, F.lit(SAID["path"])), ((F.col("path") == "/health") & (F.col("method") == "GET"), 200, F.lit(SAID["health"])),
        ((F.col("path") == "/health") | ~F.col("method").isin("GET", "POST"), 405, F.lit(SAID["method"])), (blank(F.col("text")), 400, F.lit(SAID["text"])),
        (~F.col("format").isin(*FORMATS), 400, unknown),
    ]
    status = said = F
    for hit, number, body in cases:
        status, said = status.when(hit, number), said.when(hit, body)
    return rows.withColumn("status", status).withColumn("said", said).drop("_query")


def respond(tagger, requests: DataFrame, key: str, plan: str | None = None) -> DataFrame:
    """``key`` (see ``matching.key_names``), status, response (JSON) of every request; key tells requests apart."""
    rows = parse(requests)
    [own] = key_names([key])
    good = rows.where("status IS NULL").select(F.col(f"`{key}`"), "text", "format")
    tags = tagger.tag(good, [key], plan=plan)
    made = [formats.as_json(shape(good.where(F.col("format") == name), tags, [key]), [key]) for name, shape in zip(FORMATS, (formats.simple, formats.solr))]
    plain = rows.where("status IS NOT NULL").select(F.col(f"`{key}`").alias(own), "status", F.col("said").alias("response"))
    return plain.unionByName(made[0].unionByName(made[1]).select(F.col(f"`{own}`"), F.lit(200).alias("status"), F.col("json").alias("response")))
