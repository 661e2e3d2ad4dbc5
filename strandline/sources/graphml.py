"""GraphML: reading edges in parallel, and writing graphs with typed attributes, several graphs and parallel edges."""

from __future__ import annotations

import xml.sax.saxutils as sax

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import scalar

#: GraphML types of Spark's.
TYPES = {"int": "int", "bigint": "long", "smallint": "int", "double": "double", "float": "float", "boolean": "boolean"}


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """Edges (u, v) of a GraphML file, ends in order."""
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
    return edges.select(F.least("_source", "_target").alias("u"), F.greatest("_source", "_target").alias("v"))


def signatures(edges: DataFrame, src: str, dst: str, kind: str, directed: str) -> DataFrame:
    """(a, b, kind): the canonical signature of each edge, undirected ends in order; equal ones come once."""
    d = F.col(directed)
    return edges.select(F.when(d, F.col(src)).otherwise(F.least(src, dst)).alias("a"), F.when(d, F.col(dst)).otherwise(F.greatest(src, dst)).alias("b"), kind).distinct()


def write_graphml(graphs: dict[str, tuple[DataFrame, DataFrame]], path: str, directed: bool = False, multi: bool = False) -> None:
    """One GraphML file of named graphs; nodes have `id`, edges `u` and `v`, all other columns are attributes.

    Rows pass the driver one at a time, in order.  Null attributes are left out.  Parallel
    edges need `multi`, which gives every edge an id; without it they are an error.
    """
    q = sax.quoteattr
    keys: dict[tuple[str, str], tuple[str, str]] = {}
    for nodes, edges in graphs.values():
        for what, frame, own in (("node", nodes, ("id",)), ("edge", edges, ("u", "v"))):
            for f in frame.schema.fields:
                if f.name not in own:
                    keys.setdefault((what, f.name), (f"d{len(keys)}", TYPES.get(f.dataType.simpleString(), "string")))
    text = lambda x: sax.escape(str(scalar(x)).lower() if isinstance(x, bool) else str(scalar(x)))
    data = lambda what, r, own: "".join(f'<data key="{keys[what, c][0]}">{text(r[c])}</data>' for c in r.__fields__ if c not in own and r[c] is not None)
    with open(path, "x", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for (what, name), (key, kind) in keys.items():
            f.write(f'<key id="{key}" for="{what}" attr.name={q(name)} attr.type="{kind}"/>\n')
        for name, (nodes, edges) in graphs.items():
            f.write(f'<graph id={q(name)} edgedefault="{"directed" if directed else "undirected"}">\n')
            for r in nodes.orderBy("id").toLocalIterator():
                f.write(f"<node id={q(str(r['id']))}>{data('node', r, ('id',))}</node>\n")
            last = None
            for i, r in enumerate(edges.orderBy("u", "v").toLocalIterator()):
                if not multi and (r["u"], r["v"]) == last:
                    raise ValueError(f"parallel edges {last}")
                last = (r["u"], r["v"])
                f.write(f"<edge{f' id={q(str(i))}' if multi else ''} source={q(str(r['u']))} target={q(str(r['v']))}>{data('edge', r, ('u', 'v'))}</edge>\n")
            f.write("</graph>\n")
        f.write("</graphml>\n")
