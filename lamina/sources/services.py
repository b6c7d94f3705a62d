"""JSON in, JSON out: documents of service calls as rows, one plan for a whole batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "struct<left:double,top:double,width:double,height:double,page:int>"
GROUP = f"struct<start:bigint,end:bigint,id:int,text:string,type:string,box:{BOX}>"

#: What each service reads besides ``symbols``, and the layer it gives back.
SERVICES = {
    "words": (("tokens", "rows"), "words"),
    "citation_mentions": (("tokens", "rows", "pages"), "mentions"),
    "citation_links": (("mentions", "bibs"), "links"),
    "bibliography_entries": (("tokens", "rows", "pages"), "bib_entries"),
    "bibliography_fields": (("bib_entries",), "fields"),
    "figures_and_tables": (("tokens", "pages", "blocks", "token_groups"), "figures"),
    "layout": (("pages",), "blocks"),
    "token_groups": (("tokens", "rows", "pages"), "token_groups"),
}


def requests(raw: DataFrame, layers: tuple[str, ...], json_col: str = "json") -> dict[str, DataFrame]:
    """The layers of requests (doc_id, json), each as rows; a request that lacks one fails to compute."""
    schema = "struct<symbols:string," + ",".join(f"{x}:array<{GROUP}>" for x in layers) + ">"
    parsed = raw.select("doc_id", F.from_json(json_col, schema).alias("r"))
    out = {"symbols": parsed.select("doc_id", "r.symbols")}
    for x in layers:
        group = F.when(F.col(f"r.{x}").isNull(), F.raise_error(F.lit(f"a request lacks {x}"))).otherwise(F.col(f"r.{x}"))
        rows = parsed.select("doc_id", F.posexplode(group).alias("pos", "g"))
        out[x] = rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "g.*")
    return out


def responses(layer: DataFrame, name: str) -> DataFrame:
    """doc_id, json with the rows of a layer in order."""
    columns = [c for c in layer.columns if c != "doc_id"]
    item = F.struct("pos", *[c for c in columns if c != "pos"])
    listed = layer.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias(name))
    return listed.select("doc_id", F.to_json(F.struct(name)).alias("json"))


def serve(raw: DataFrame, service: str, predict: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """Responses of a service to a batch of requests."""
    needs, gives = SERVICES[service]
    return responses(predict(requests(raw, needs)), gives)


def attributes(metadata: DataFrame, required: tuple[str, ...] = ("type",)) -> DataFrame:
    """Metadata (doc_id, pos, metadata) as typed attributes; unknown keys are left out, missing ones fail to compute."""
    parsed = F.from_json("metadata", "struct<type:string,label:string,score:double>")
    out = metadata.select("doc_id", "pos", parsed.alias("a")).select("doc_id", "pos", "a.*")
    for name in required:
        out = out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"missing attribute {name}"))).otherwise(F.col(name)))
    return out


def read_labels(spark, path: str) -> DataFrame:
    """Evaluation labels: a JSON array of id, url, title, abstract."""
    return spark.read.schema("id string, url string, title string, abstract string").option("multiLine", True).json(path)


def read_dictionary(spark, path: str) -> DataFrame:
    """One word a line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
