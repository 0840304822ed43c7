"""Node and edge tables of the entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.functions import fixed
from usetrail.functions.columns import col_of, entity_key, line_of
from usetrail.operators.symbols import resolve_asof
from usetrail.plans.scan import stacked

NO_EXTRA = "CAST(NULL AS MAP<STRING, BOOLEAN>)"


def graph_nodes(
    entities: DataFrame, kinds: dict[str, tuple[str, str, str | None]], doc: list[str] | None = None
) -> DataFrame:
    """Typed nodes from rows (kind, name, line, col, end_line, end_col), after the columns `doc`.

    `kinds` maps a row kind to (entity type, id prefix, fixed label or None for the
    name); one CASE per column, so the rows are read once.
    """
    of_type = F.lit(None).cast("string")
    prefix = F.lit(None).cast("string")
    label = F.col("name")
    for kind, (entity_type, short, fixed_label) in kinds.items():
        of_type = F.when(F.col("kind") == kind, entity_type).otherwise(of_type)
        prefix = F.when(F.col("kind") == kind, short).otherwise(prefix)
        if fixed_label:
            label = F.when(F.col("kind") == kind, F.lit(fixed_label)).otherwise(label)
    return entities.filter(F.col("kind").isin(list(kinds))).select(
        *(doc or []), entity_key(prefix, label, F.col("line"), F.col("col"), F.col("end_col")).alias("id"),
        label.alias("label"), of_type.alias("entity_type"),
        _range().alias("range"), F.expr(NO_EXTRA).alias("extra"),
    )


CODE_NODES = {
    "variable": ("Variable", "var", None),
    "function_declaration": ("Function", "fn", None),
    "go_statement": ("Goroutine", "go", "goroutine"),
    "channel_type": ("Channel", "chan", "channel"),
}


def _range() -> Column:
    start = F.struct(F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))
    end = F.struct(
        F.col("end_line").cast("int").alias("line"), F.col("end_col").cast("int").alias("col")
    )
    return F.struct(start.alias("start"), end.alias("end"))


def _own_key(prefix: str, name: Column) -> Column:
    return entity_key(F.lit(prefix), name, F.col("line"), F.col("col"), F.col("end_col"))


def use_links(
    occurrences: DataFrame, keys: list[str], order: list[str], is_decl: Column, name: Column, bounded: bool = False
) -> DataFrame:
    """Every use with the id of the latest earlier declaration of its name."""
    found = resolve_asof(occurrences, keys, order, is_decl, _own_key("var", name), "from_id", bounded)
    return found.filter(~is_decl & F.col("from_id").isNotNull()).withColumn(
        "to_id", _own_key("use", name)
    )


def use_nodes(links: DataFrame, name: Column, doc: list[str] | None = None) -> DataFrame:
    return links.select(
        *(doc or []), F.col("to_id").alias("id"), name.alias("label"), F.lit("Variable").alias("entity_type"),
        _range().alias("range"), F.create_map(F.lit("use"), F.lit(True)).alias("extra"),
    )


def use_edges(links: DataFrame, doc: list[str] | None = None) -> DataFrame:
    return links.select(*(doc or []), "from_id", "to_id", F.lit("Use").alias("edge_type"))


def site_edges(
    sites: DataFrame, edge_type: str, from_prefix: str, to_prefix: str,
    from_name: Column, to_name: Column, target: tuple[str, str, str] | None = None,
    doc: list[str] | None = None,
) -> DataFrame:
    """Edges from a site to what it names.

    Both ids carry the site's own address unless `target` gives the address columns
    (line, col, end_col) of the named thing.
    """
    line, col, end_col = target or ("line", "col", "end_col")
    to_key = entity_key(F.lit(to_prefix), to_name, F.col(line), F.col(col), F.col(end_col))
    return sites.select(
        *(doc or []), _own_key(from_prefix, from_name).alias("from_id"), to_key.alias("to_id"),
        F.lit(edge_type).alias("edge_type"),
    )


def call_edges(calls: DataFrame, name: Column, target=None, doc=None) -> DataFrame:
    return site_edges(calls, "Call", "callsite", "fn", name, name, target, doc)


def sync_edges(calls: DataFrame, doc: list[str] | None = None) -> DataFrame:
    return site_edges(calls, "Sync", "callsite", "sync", F.lit("sync"), F.lit("sync"), doc=doc)


def send_edges(ops: DataFrame, name: Column, target=None, doc=None) -> DataFrame:
    return site_edges(ops, "Send", "send", "chan", name, name, target, doc)


def receive_edges(ops: DataFrame, name: Column, target=None, doc=None) -> DataFrame:
    return site_edges(ops, "Receive", "recv", "chan", name, name, target, doc)


def spawn_edges(sites: DataFrame, doc: list[str] | None = None) -> DataFrame:
    return site_edges(sites, "Spawn", "spawnsite", "go", F.lit("go"), F.lit("goroutine"), doc=doc)


def _addressed(nodes: DataFrame) -> DataFrame:
    """Line and column of both ends of each node."""
    return nodes.select(
        "*", line_of(F.col("start_pos")).alias("line"), col_of(F.col("start_pos")).alias("col"),
        line_of(F.col("end_pos")).alias("end_line"), col_of(F.col("end_pos")).alias("end_col"),
    )


def code_graph(nodes: DataFrame, sync_calls: DataFrame, bounded: bool = True) -> tuple[DataFrame, DataFrame]:
    """Graph of a syntax-node table: (doc_id, node columns) and (doc_id, edge columns).

    `sync_calls` (doc_id, node_id) are the calls that lock, unlock or act atomically.
    `bounded`: the nodes of a document come out of one text (as in `running`).

    Variables are the names right under a declaration; what they declare holds for the rest
    of the document, the latest declaration of a name first. A call, send, receive or spawn
    is an edge of its statement; what it names is found over the field of the child. Nodes
    with one id are one node. No step but the unions moves rows away from their document.
    """
    doc = ["doc_id"]
    all_nodes = _addressed(nodes)
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    above = above.hint("shuffle_hash") if bounded else above
    names = all_nodes.filter("kind = 'identifier'").join(above, [*doc, "parent_id"]).select(
        *doc, "parent_id", "parent_kind", "field", F.trim("text").alias("name"), "start_pos", "line", "col", "end_line", "end_col",
    )
    declares = F.col("parent_kind").isin("var_spec", "short_var_declaration")
    links = use_links(names, [*doc, "name"], ["start_pos"], declares, F.col("name"), bounded)
    function = (F.col("parent_kind") == "function_declaration") & (F.col("field") == "name")
    named = names.withColumn("kind", F.when(declares, "variable").when(function, "function_declaration"))
    # the three have no id in common, as their prefixes differ
    made = stacked(*[part.dropDuplicates([*doc, "id"]) for part in (
        graph_nodes(named, CODE_NODES, doc),
        graph_nodes(all_nodes.filter(F.col("kind").isin("go_statement", "channel_type")).withColumn("name", F.lit(None).cast("string")),
                    CODE_NODES, doc),
        use_nodes(links, F.col("name"), doc),
    )])

    def sites(kinds: list[str], slot: str) -> DataFrame:
        part = all_nodes.filter(F.col("field") == slot).select(
            *doc, F.col("parent_id").alias("node_id"), F.trim("text").alias("name"), F.col("line").alias("at_line"),
            F.col("col").alias("at_col"), F.col("end_col").alias("at_end"),
        )
        return all_nodes.filter(F.col("kind").isin(kinds)).join(part, [*doc, "node_id"])

    target, name = ("at_line", "at_col", "at_end"), F.col("name")
    operand = nodes.filter("field = 'operator' AND kind = '<-'").select(*doc, F.col("parent_id").alias("node_id"))
    received = sites(["unary_expression"], "operand").join(operand, [*doc, "node_id"], "left_semi")
    edges = stacked(
        use_edges(links, doc), call_edges(sites(["call_expression"], "function"), name, target, doc),
        send_edges(sites(["send_statement"], "channel"), name, target, doc),
        receive_edges(received, name, target, doc), spawn_edges(all_nodes.filter("kind = 'go_statement'"), doc),
        sync_edges(all_nodes.join(sync_calls.select(*doc, "node_id"), [*doc, "node_id"], "left_semi"), doc),
    )
    return made, edges


def build_graph(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The two graph tables."""
    return stacked(*nodes), stacked(*edges)


def bad_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Types outside the fixed domains."""
    n = nodes.filter(~F.col("entity_type").isin(fixed.GRAPH_TYPES)).select(
        F.lit("node").alias("part"), F.col("entity_type").alias("type")
    )
    e = edges.filter(~F.col("edge_type").isin(fixed.EDGE_TYPES)).select(
        F.lit("edge").alias("part"), F.col("edge_type").alias("type")
    )
    return stacked(n, e)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which end."""
    ids = nodes.select("id").distinct()
    ends = edges.select(
        "*", F.explode(F.array(F.lit("from"), F.lit("to"))).alias("end")
    ).withColumn("_id", F.when(F.col("end") == "from", F.col("from_id")).otherwise(F.col("to_id")))
    return ends.join(ids, F.col("_id") == F.col("id"), "left_anti").drop("_id")
