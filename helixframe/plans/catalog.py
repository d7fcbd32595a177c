"""Registered queries of the graph operators over the driver's tables, with their DuckDB SQL.

No table holds DNA, so both engines derive it by the same rule: block j of the genome is
the MD5 of j with the hex digits mapped to bases, there is one block for each row of
``part``, and each row of ``orders`` is a read of 60 bases.  Some reads get a changed
base (tips and bubbles), some a letter that isn't a base.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import contig_stats as cstats
from helixframe.operators import graph, paths
from helixframe.plans import oracles
from helixframe.plans.assembler import assemble_graph, build
from helixframe.sources import readers, sinks
from helixframe.storage import new_folder

K, READ, THRESHOLD = 21, 60, 3
#: Edges under this weight go to break the well-covered graph into many fragments, short ones among them.
FRAGMENTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _block(j):
    return F.translate(F.md5(j.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq for each order; the genome's length is one number."""
    size = table(spark, sf_dir, "part").agg((F.count(F.lit(1)) * 32).alias("size"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"))
    o = o.crossJoin(F.broadcast(size)).withColumn("at", F.col("read_id") * 7919 % (F.col("size") - READ))
    j = F.floor(F.col("at") / 32)
    seq = F.substring(F.concat(_block(j), _block(j + 1), _block(j + 2)), (F.col("at") % 32 + 1).cast("int"), READ)
    o = o.select("read_id", seq.alias("s"), (F.col("read_id") % 97 == 0).alias("wrong"), (F.col("read_id") % 89 == 0).alias("unknown"))
    s = F.when(F.col("unknown"), F.concat(F.left("s", F.lit(29)), F.lit("N"), F.right("s", F.lit(30)))).when(F.col("wrong"), F.concat(F.left("s", F.lit(29)), F.translate(F.substring("s", 30, 1), "ACGT", "CGTA"), F.right("s", F.lit(30)))).otherwise(F.col("s"))
    return o.select("read_id", s.alias("seq"))


def weighted_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, kmer, weight for each line item: a k-mer table with repeats, hence parallel edges."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_id"), F.left(_block(F.col("l_partkey")), F.lit(K)).alias("kmer"), F.col("l_quantity").cast("long").alias("weight"))
    return li


def number_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to suppliers, weighted by the number of line items: a graph without DNA."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("weight"))
    return li.select((F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("edge_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("").alias("label"), "weight")


def _edges(spark, d):
    return graph.kmer_graph(raw_reads(spark, d), K)


def _fragments(spark, d):
    return graph.remove_weak_edges(_edges(spark, d), FRAGMENTS)


def _genome(spark, d):
    return 32 * table(spark, d, "part").count()


def _plain(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "label", "weight")


def _isolated(spark, d):
    e = _edges(spark, d)
    return graph.isolated_nodes(graph.nodes(e), graph.remove_weak_edges(e, THRESHOLD))


def _lengths(spark, d):
    return raw_reads(spark, d).select(F.length("seq").cast("long").alias("len")).unionByName(table(spark, d, "documents").select(F.length("text").cast("long").alias("len")))


def _unitig_sizes(spark, d):
    e = _edges(spark, d)
    return paths.unitigs(e).groupBy("unitig_id").agg(F.count(F.lit(1)).alias("edges"), F.max("dist").alias("last"))


def _codec(spark, d):
    r = graph.accepted(raw_reads(spark, d))
    r = r.select("read_id", "seq", dna.pack("seq").alias("p"), dna.pack_edge(F.col("seq")).alias("e"))
    return r.select("read_id", F.lower(F.hex("p")).alias("packed"), F.lower(F.hex("e")).alias("edge"), (dna.unpack_edge(F.col("e")) == F.col("seq")).alias("same"))


def _labels(spark, d):
    r = graph.accepted(raw_reads(spark, d))
    s = F.col("seq")
    return r.select("read_id", dna.source(s, K).alias("src"), dna.target(s, K).alias("dst"), dna.remainder(s, K).alias("rest"), dna.merge_labels(s, F.col("seq"), K).alias("merged"), dna.last_base(s).alias("last"), dna.replace_last_base(s, F.lit("T")).alias("replaced"), dna.append_bases(s, F.lit("GA")).alias("longer"), dna.replace_base_and_clear(F.left(s, F.lit(4)), F.lit(1), F.lit("G")).alias("chunk"), dna.codes(s).alias("codes"))


def _pipeline(spark, d):
    return assemble_graph(_edges(spark, d), K, _genome(spark, d), THRESHOLD).contigs


def _codec_padded(spark, d):
    """Reads of 57 to 60 bases, so that every number of padding bases comes up."""
    r = graph.accepted(raw_reads(spark, d)).select("read_id", F.left("seq", (F.col("read_id") % 4 + 57).cast("int")).alias("seq"))
    r = r.select("read_id", "seq", dna.pack_edge(F.col("seq")).alias("e"))
    return r.select("read_id", F.lower(F.hex("e")).alias("edge"), (dna.unpack_edge(F.col("e")) == F.col("seq")).alias("same"))


def _files(spark, lines: DataFrame, name: str) -> list[str]:
    """Text files of lines(value), in the folder that all executors share."""
    folder = new_folder(spark, name)
    lines.write.text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(x.getPath().toString() for x in found if x.getPath().getName().startswith("part-"))


def _fastq(spark, d) -> list[str]:
    value = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id")), "seq", F.lit("+"), F.repeat(F.lit("@"), F.length("seq")))
    return _files(spark, raw_reads(spark, d).select(value.alias("value")), "fastq")


def _fasta(spark, d) -> list[str]:
    value = F.concat_ws("\n", F.concat(F.lit(">"), F.col("read_id"), F.lit(" a read")), F.left("seq", F.lit(25)), F.substring("seq", 26, 35))
    return _files(spark, raw_reads(spark, d).select(value.alias("value")), "fasta")


def _table_files(spark, d) -> list[str]:
    return _files(spark, weighted_kmers(spark, d).select(F.concat_ws("\t", "kmer", F.col("weight").cast("string"), F.lit("more")).alias("value")), "kmers")


def _config(spark, d, files: list[str], kind: str, **more) -> readers.Config:
    return readers.Config(tuple(files), readers.InputFileType(kind), "", _genome(spark, d), THRESHOLD, K, **more)


def _toml_graph(spark, d):
    """The graph that a configuration as text asks for."""
    text = f'input_files = {json.dumps(_fastq(spark, d))}\ninput_file_type = "Fastq"\noutput_file = "none"\noriginal_genome_length = {_genome(spark, d)}\nminimal_weight_threshold = {THRESHOLD}\nk_mer_size = {K}\nreverse_complement = true\n'
    return _plain(graph.remove_weak_edges(build(spark, readers.parse_config(text)), THRESHOLD))


def _written_fasta(spark, d):
    """Records as they are read back from one file that was written."""
    path = f"{new_folder(spark, 'contigs')}.fasta"
    sinks.write_fasta_file(graph.accepted(raw_reads(spark, d)).select(F.col("read_id").alias("contig_id"), "seq"), path)
    back = readers.read_fasta(spark, [path])
    return back.select(F.row_number().over(Window.orderBy("read_id")).alias("nth"), "seq")


def _edits(spark, d):
    """An edge put behind the outgoing edges of a node, and their first one taken away."""
    adj = graph.adjacency(_edges(spark, d))
    text = lambda x: F.array_join(F.transform(x, lambda e: F.concat_ws(":", e["dst"], e["weight"].cast("string"))), ",")
    more = graph.add_edge(F.col("outgoing"), F.lit("NEW"), F.lit(7).cast("long"), F.lit("W"), F.lit(-1).cast("long"))
    return adj.select("node", text(more).alias("more"), text(graph.drop_edge_at(F.col("outgoing"), 0)).alias("fewer"))


QUERIES = {
    "graph_stats": lambda s, d: graph.graph_stats(_edges(s, d)),
    "read_filter": lambda s, d: graph.accepted(raw_reads(s, d)),
    "read_filter_documents": lambda s, d: graph.accepted(table(s, d, "documents").select(F.col("doc_id").alias("read_id"), F.regexp_replace(F.upper("text"), "[^ACGTX]", "").alias("seq"))),
    "read_bytes": lambda s, d: graph.accepted_bytes(raw_reads(s, d)),
    "kmer_windows": lambda s, d: graph.kmer_spans(raw_reads(s, d), K),
    "kmer_count": lambda s, d: _edges(s, d).select(F.col("label").alias("kmer"), "weight"),
    "kmer_count_rc": lambda s, d: graph.kmer_graph(raw_reads(s, d), K, True).select(F.col("label").alias("kmer"), "weight"),
    "reverse_complement": lambda s, d: graph.accepted(raw_reads(s, d)).select("read_id", dna.reverse_complement(F.col("seq")).alias("rc")),
    "encode_2bit": _codec,
    "label_functions": _labels,
    "bfc_scan_filter": lambda s, d: graph.weighted_graph(weighted_kmers(s, d).where("weight >= 25"), K).select("edge_id", "src", "dst", "label", "weight"),
    "bfc_edges_rc": lambda s, d: graph.weighted_graph(weighted_kmers(s, d), K, True).groupBy("label").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")),
    "edges": lambda s, d: _plain(_edges(s, d)),
    "nodes": lambda s, d: graph.nodes(_edges(s, d)),
    "degrees": lambda s, d: graph.degrees(_edges(s, d)),
    "degrees_numbers": lambda s, d: graph.degrees(number_graph(s, d)),
    "ambiguous_nodes": lambda s, d: graph.ambiguous_nodes(_edges(s, d)),
    "external_nodes": lambda s, d: graph.external_nodes(_edges(s, d)),
    "first_edges": lambda s, d: _edges(s, d).groupBy("src").agg(F.max_by("label", "edge_id").alias("label")),
    "adjacency": lambda s, d: graph.adjacency(_edges(s, d)).select("node", F.array_join(F.transform("outgoing", lambda e: F.concat_ws(":", e["dst"], e["weight"].cast("string"), e["last_char"])), ",").alias("outgoing")),
    "adjacency_roundtrip": lambda s, d: _plain(graph.from_adjacency(graph.adjacency(_edges(s, d)))),
    "adjacency_weak": lambda s, d: graph.drop_weak_adjacency(graph.adjacency(_edges(s, d)), THRESHOLD).select("node", F.size("outgoing").alias("n")),
    "adjacency_stats": lambda s, d: graph.adjacency_stats(graph.adjacency(_edges(s, d))).select("node_count", "edge_count"),
    "has_incoming": lambda s, d: graph.with_incoming(_edges(s, d)),
    "isolated_nodes": _isolated,
    "weak_edges": lambda s, d: _plain(graph.remove_weak_edges(_edges(s, d), THRESHOLD)),
    "weak_edges_numbers": lambda s, d: graph.remove_weak_edges(number_graph(s, d), 2).select("src", "dst", "weight"),
    "label_stats": lambda s, d: graph.label_stats(_edges(s, d)),
    "std_ratio": lambda s, d: paths.standardization_ratio(_edges(s, d), _genome(s, d), K, THRESHOLD),
    "std_edges": lambda s, d: _plain(paths.standardize_edges(_edges(s, d), _genome(s, d), K, THRESHOLD)),
    "contig_stats": lambda s, d: cstats.contig_stats(_lengths(s, d), 1_000_000),
    "fasta_lines": lambda s, d: sinks.fasta_lines(graph.accepted(raw_reads(s, d)).select(F.col("read_id").alias("contig_id"), "seq")),
    "dot_lines": lambda s, d: sinks.dot_lines(_edges(s, d)),
    "graph_dump": lambda s, d: sinks.dump(_edges(s, d)),
    "unitigs": _unitig_sizes,
    "std_contigs": lambda s, d: _plain(paths.standardize_contigs(_edges(s, d))),
    "shrink": lambda s, d: _plain(paths.shrink(_edges(s, d), K)),
    "dead_paths": lambda s, d: _plain(paths.remove_dead_paths(_edges(s, d), K)),
    "wcc_count": lambda s, d: paths.weak_components(_edges(s, d)).agg(F.countDistinct("component").alias("components")),
    "collapse": lambda s, d: paths.collapse(_edges(s, d), K),
    "full_pipeline": _pipeline,
    "dead_paths_fragments": lambda s, d: _plain(paths.remove_dead_paths(_fragments(s, d), K)),
    "wcc_fragments": lambda s, d: paths.weak_components(_fragments(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).groupBy("nodes").agg(F.count(F.lit(1)).alias("components")),
    "collapse_fragments": lambda s, d: paths.collapse(paths.standardize_contigs(_fragments(s, d)), K),
    "full_pipeline_fragments": lambda s, d: assemble_graph(_edges(s, d), K, _genome(s, d), FRAGMENTS).contigs,
    "shrink_through": lambda s, d: _plain(paths.shrink(_edges(s, d), K, graph.nodes(_edges(s, d)).where("not endswith(node, 'T')"))),
    "encode_2bit_padded": _codec_padded,
    "adjacency_edits": _edits,
    "fastq_scan": lambda s, d: readers.read_fastq(s, _fastq(s, d)).select("seq"),
    "fasta_scan": lambda s, d: readers.read_fasta(s, _fasta(s, d)).select("seq"),
    "bfcounter_scan": lambda s, d: readers.read_bfcounter(s, _table_files(s, d), 25, K).select("kmer", "weight"),
    "fasta_written": _written_fasta,
    "fastq_graph": lambda s, d: _plain(build(s, _config(s, d, _fastq(s, d), "FastQ"))),
    "fastq_graph_via_adjacency": lambda s, d: _plain(build(s, _config(s, d, _fastq(s, d), "fastq"), via_adjacency=True)),
    "toml_graph_rc": _toml_graph,
    "contig_stats_empty": lambda s, d: cstats.contig_stats(_lengths(s, d).where("len < 0"), 1_000_000),
    "fasta_graph_rc": lambda s, d: build(s, _config(s, d, _fasta(s, d), "fasta", reverse_complement=True)).select(F.col("label").alias("kmer"), "weight"),
    "bfcounter_graph_rc": lambda s, d: build(s, _config(s, d, _table_files(s, d), "bfcounter", reverse_complement=True)).groupBy("label").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")),
}

_BLOCK = "translate(md5(CAST({0} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_READS = f"""
pos AS (SELECT o_orderkey AS read_id, o_orderkey * 7919 % ((SELECT count(*) * 32 FROM part) - {READ}) AS start FROM orders),
base AS (SELECT read_id, substring({_BLOCK.format("CAST(floor(start / 32.0) AS BIGINT)")} || {_BLOCK.format("(CAST(floor(start / 32.0) AS BIGINT) + 1)")} || {_BLOCK.format("(CAST(floor(start / 32.0) AS BIGINT) + 2)")}, CAST(start % 32 + 1 AS INT), {READ}) AS s FROM pos),
raw AS (SELECT read_id, CASE WHEN read_id % 89 = 0 THEN left(s, 29) || 'N' || right(s, 30) WHEN read_id % 97 = 0 THEN left(s, 29) || translate(substring(s, 30, 1), 'ACGT', 'CGTA') || right(s, 30) ELSE s END AS seq FROM base),
reads AS (SELECT * FROM raw WHERE regexp_full_match(seq, '[ACGT]*'))"""
_WINDOWS = f"win AS (SELECT read_id * 2097152 + i AS edge_id, substring(seq, i + 1, {K}) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {K - 1})) AS i FROM reads))"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_EDGES = f"{_READS}, {_WINDOWS}, edges AS (SELECT min(edge_id) AS edge_id, left(kmer, {K - 1}) AS src, right(kmer, {K - 1}) AS dst, kmer AS label, count(*) AS weight FROM win GROUP BY kmer)"
_DEG = """deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)"""
_NODES = "nodes AS (SELECT DISTINCT node FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges))"
_BFC = f"bfc AS (SELECT l_orderkey * 8 + l_linenumber AS read_id, left({_BLOCK.format('l_partkey')}, {K}) AS kmer, CAST(l_quantity AS BIGINT) AS weight FROM lineitem)"
_NUM = "edges AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey)"
_P = f"p AS (SELECT ((SELECT count(*) * 32 FROM part) - {K}) / CAST(sum(weight) - coalesce(sum(weight) FILTER (WHERE weight < {THRESHOLD}), 0) AS DOUBLE) AS p FROM edges)"
_DIGITS = "translate({0}, 'ACGT', '0123')"
_PACKED = "lower(string_agg(to_hex(CAST(substring(d, i, 1) AS INT) * 4 + CAST(substring(d, i + 1, 1) AS INT)), '' ORDER BY i))"


def _with(parts: str, select: str) -> str:
    return f"WITH {parts} {select}"


_GENOME = "(SELECT count(*) * 32 FROM part)"
_BUILT = f"RECURSIVE {_READS}, {_WINDOWS}, edges AS MATERIALIZED (SELECT min(edge_id) AS edge_id, left(kmer, {K - 1}) AS src, right(kmer, {K - 1}) AS dst, kmer AS label, count(*) AS weight FROM win GROUP BY kmer)"
_BROKEN = f"{_BUILT}, {oracles.weak_edges('edges', 'f', FRAGMENTS)}"

ORACLE_SQL = {
    "graph_stats": _with(f"{_EDGES}, {_DEG}", "SELECT (SELECT count(*) FROM deg) AS node_count, count(*) AS edge_count, coalesce(max(weight), 0) AS max_edge_weight, avg(weight) AS avg_edge_weight, (SELECT coalesce(max(in_degree), 0) FROM deg) AS max_in_degree, (SELECT coalesce(max(out_degree), 0) FROM deg) AS max_out_degree, count(*) / CAST((SELECT count(*) FROM deg) AS DOUBLE) AS avg_out_degree, (SELECT count(*) FROM deg WHERE in_degree = 0) AS incoming_vert_count, (SELECT count(*) FROM deg WHERE out_degree = 0) AS outgoing_vert_count FROM edges"),
    "read_filter": _with(_READS, "SELECT read_id, seq FROM reads"),
    "read_filter_documents": "SELECT * FROM (SELECT doc_id AS read_id, regexp_replace(upper(text), '[^ACGTX]', '', 'g') AS seq FROM documents) WHERE regexp_full_match(seq, '[ACGT]*')",
    "read_bytes": _with(_READS, "SELECT CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bytes FROM reads"),
    "kmer_windows": _with(f"{_READS}, {_WINDOWS}", "SELECT kmer, min(edge_id) AS first_seen, max(edge_id) AS last_seen FROM win GROUP BY kmer"),
    "kmer_count": _with(_EDGES, "SELECT label AS kmer, weight FROM edges"),
    "kmer_count_rc": _with(f"{_READS}, {_WINDOWS}", f"SELECT kmer, count(*) AS weight FROM (SELECT kmer FROM win UNION ALL SELECT {_RC.format('kmer')} FROM win) GROUP BY kmer"),
    "reverse_complement": _with(_READS, f"SELECT read_id, {_RC.format('seq')} AS rc FROM reads"),
    "encode_2bit": _with(_READS, f"SELECT read_id, {_PACKED} AS packed, '00' || {_PACKED} AS edge, true AS same FROM (SELECT read_id, {_DIGITS.format('seq')} AS d, unnest(range(1, length(seq), 2)) AS i FROM reads) GROUP BY read_id"),
    "label_functions": _with(_READS, f"SELECT read_id, left(seq, {K - 1}) AS src, right(seq, {K - 1}) AS dst, substring(seq, {K}) AS rest, seq || substring(seq, {K}) AS merged, right(seq, 1) AS last, left(seq, length(seq) - 1) || 'T' AS replaced, seq || 'GA' AS longer, left(seq, 1) || 'GAA' AS chunk, {_DIGITS.format('seq')} AS codes FROM reads"),
    "bfc_scan_filter": _with(_BFC, f"SELECT read_id * 2097152 AS edge_id, left(kmer, {K - 1}) AS src, right(kmer, {K - 1}) AS dst, kmer AS label, weight FROM bfc WHERE weight >= 25"),
    "bfc_edges_rc": _with(_BFC, f"SELECT label, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT kmer AS label, weight FROM bfc UNION ALL SELECT {_RC.format('kmer')}, weight FROM bfc) GROUP BY label"),
    "edges": _with(_EDGES, "SELECT src, dst, label, weight FROM edges"),
    "nodes": _with(f"{_EDGES}, {_NODES}", "SELECT node FROM nodes"),
    "degrees": _with(f"{_EDGES}, {_DEG}", "SELECT * FROM deg"),
    "degrees_numbers": _with(f"{_NUM}, {_DEG}", "SELECT * FROM deg"),
    "ambiguous_nodes": _with(f"{_EDGES}, {_DEG}", "SELECT node FROM deg WHERE in_degree > 1 OR out_degree > 1 OR (in_degree = 0 AND out_degree >= 1)"),
    "external_nodes": _with(f"{_EDGES}, {_DEG}", "SELECT node, CASE WHEN in_degree = 0 THEN 'input' ELSE 'output' END AS kind FROM deg WHERE in_degree = 0 OR out_degree = 0"),
    "first_edges": _with(_EDGES, "SELECT src, arg_max(label, edge_id) AS label FROM edges GROUP BY src"),
    "adjacency": _with(f"{_EDGES}, {_NODES}", "SELECT node, coalesce(string_agg(dst || ':' || weight || ':' || right(dst, 1), ',' ORDER BY dst), '') AS outgoing FROM nodes LEFT JOIN edges ON node = src GROUP BY node"),
    "adjacency_roundtrip": _with(_EDGES, "SELECT src, dst, label, weight FROM edges"),
    "adjacency_weak": _with(f"{_EDGES}, strong AS (SELECT * FROM edges WHERE weight >= {THRESHOLD})", "SELECT node, CAST(sum(o) AS INT) AS n FROM (SELECT src AS node, 1 AS o FROM strong UNION ALL SELECT dst, 0 FROM strong) GROUP BY node"),
    "adjacency_stats": _with(f"{_EDGES}, {_NODES}", "SELECT (SELECT count(*) FROM nodes) AS node_count, count(*) AS edge_count FROM edges"),
    "has_incoming": _with(_EDGES, "SELECT DISTINCT dst AS node FROM edges"),
    "isolated_nodes": _with(f"{_EDGES}, {_NODES}", f"SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM edges WHERE weight >= {THRESHOLD}) AND node NOT IN (SELECT dst FROM edges WHERE weight >= {THRESHOLD})"),
    "weak_edges": _with(_EDGES, f"SELECT src, dst, label, weight FROM edges WHERE weight >= {THRESHOLD}"),
    "weak_edges_numbers": _with(_NUM, "SELECT src, dst, weight FROM edges WHERE weight >= 2"),
    "label_stats": _with(_EDGES, "SELECT avg(length(label)) AS avg_label, CAST(sum(ceil(length(label) / 4.0) + 1) AS BIGINT) AS packed_bytes, 100 * (1 - sum(ceil(length(label) / 4.0) + 1) / CAST(sum(length(label)) AS DOUBLE)) AS saved_percent FROM edges"),
    "std_ratio": _with(f"{_EDGES}, {_P}", "SELECT p FROM p"),
    "std_edges": _with(f"{_EDGES}, {_P}, s AS (SELECT src, dst, label, CAST(CASE WHEN round(weight * p) = 0 AND weight >= {THRESHOLD} THEN 1 ELSE round(weight * p) END AS BIGINT) AS weight FROM edges, p)", "SELECT * FROM s WHERE weight >= 1"),
    "contig_stats": _with(
        f"{_READS}, l AS (SELECT row_number() OVER () AS id, len FROM (SELECT length(seq) AS len FROM raw UNION ALL SELECT length(text) FROM documents)), c AS (SELECT len, sum(len) OVER (ORDER BY len, id) AS a, sum(len) OVER (ORDER BY len DESC, id DESC) AS d, sum(len) OVER () AS t FROM l)",
        "SELECT CAST(coalesce(min(len) FILTER (WHERE a >= floor(t / 2.0)), max(len), 0) AS BIGINT) AS n50, count(*) FILTER (WHERE d - len < floor(t / 2.0)) AS l50, CAST(coalesce(min(len) FILTER (WHERE a >= floor(CAST(t AS DOUBLE) * 0.1)), max(len), 0) AS BIGINT) AS n90, CAST(coalesce(min(len) FILTER (WHERE a >= 500000), max(len), 0) AS BIGINT) AS ng50 FROM c",
    ),
    "fasta_lines": _with(_READS, "SELECT read_id AS contig_id, '>contig_' || read_id || chr(10) || seq AS value FROM reads"),
    "dot_lines": _with(_EDGES, "SELECT '    \"' || src || '\" -> \"' || dst || '\" [ label = \"' || label || ' (' || weight || ')\" ]' AS value FROM edges"),
    "graph_dump": _with(_EDGES, "SELECT label || ' X weight ' || weight AS value FROM edges"),
    "unitigs": _with(f"{_BUILT}, {oracles.unitigs('edges', 'u')}", "SELECT unitig_id, count(*) AS edges, max(dist) AS last FROM u GROUP BY unitig_id"),
    "std_contigs": _with(f"{_BUILT}, {oracles.standardize_contigs('edges', 's')}", "SELECT src, dst, label, weight FROM s"),
    "shrink": _with(f"{_BUILT}, {oracles.shrink('edges', 'c', K)}", "SELECT src, dst, label, weight FROM c"),
    "dead_paths": _with(f"{_BUILT}, {oracles.remove_dead_paths('edges', 'd', K)}", "SELECT src, dst, label, weight FROM d"),
    "wcc_count": _with(f"{_BUILT}, {oracles.shrink('edges', 'c', K)}, {oracles.weak_components('c', 'w')}", "SELECT count(DISTINCT component) AS components FROM w"),
    "collapse": _with(f"{_BUILT}, {oracles.collapse('edges', 'c', K)}", "SELECT contig_id, seq, len FROM c"),
    "full_pipeline": _with(f"{_BUILT}, {oracles.assembly('edges', 'a', _GENOME, K, THRESHOLD)}", "SELECT contig_id, seq, len FROM a"),
    "dead_paths_fragments": _with(f"{_BROKEN}, {oracles.remove_dead_paths('f', 'd', K)}", "SELECT src, dst, label, weight FROM d"),
    "wcc_fragments": _with(f"{_BROKEN}, {oracles.shrink('f', 'c', K)}, {oracles.weak_components('c', 'w')}", f"SELECT nodes, count(*) AS components FROM (SELECT component, CAST(sum(nodes) AS BIGINT) AS nodes FROM (SELECT component, count(*) AS nodes FROM w GROUP BY component UNION ALL SELECT component, length(label) - {K} FROM c JOIN w ON src = node) GROUP BY component) GROUP BY nodes"),
    "collapse_fragments": _with(f"{_BROKEN}, {oracles.standardize_contigs('f', 's')}, {oracles.collapse('s', 'c', K)}", "SELECT contig_id, seq, len FROM c"),
    "full_pipeline_fragments": _with(f"{_BUILT}, {oracles.assembly('edges', 'a', _GENOME, K, FRAGMENTS)}", "SELECT contig_id, seq, len FROM a"),
    "shrink_through": _with(f"{_BUILT}, {oracles.shrink('edges', 'c', K, 'NOT ends_with(d.node, ' + chr(39) + 'T' + chr(39) + ')')}", "SELECT src, dst, label, weight FROM c"),
    "encode_2bit_padded": _with(
        f"{_READS}, cut AS (SELECT read_id, left(seq, CAST(57 + read_id % 4 AS INT)) AS s FROM reads), even AS (SELECT read_id, (4 - length(s) % 4) % 4 AS pad, {_DIGITS.format('s')} || repeat('0', (4 - length(s) % 4) % 4) AS d FROM cut)",
        f"SELECT read_id, '0' || any_value(pad) || {_PACKED} AS edge, true AS same FROM (SELECT read_id, pad, d, unnest(range(1, length(d), 2)) AS i FROM even) GROUP BY read_id",
    ),
    "adjacency_edits": _with(
        f"{_EDGES}, {_NODES}, o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, weight) AS nth FROM edges)",
        "SELECT node, coalesce(string_agg(dst || ':' || weight, ',' ORDER BY nth) || ',', '') || 'NEW:7' AS more, coalesce(string_agg(dst || ':' || weight, ',' ORDER BY nth) FILTER (WHERE nth > 1), '') AS fewer FROM nodes LEFT JOIN o ON node = src GROUP BY node",
    ),
    "fastq_scan": _with(_READS, "SELECT seq FROM raw"),
    "fasta_scan": _with(_READS, "SELECT seq FROM raw"),
    "bfcounter_scan": _with(_BFC, "SELECT kmer, weight FROM bfc WHERE weight >= 25"),
    "fasta_written": _with(_READS, "SELECT CAST(row_number() OVER (ORDER BY read_id) AS INT) AS nth, seq FROM reads"),
    "fastq_graph": _with(_EDGES, "SELECT src, dst, label, weight FROM edges"),
    "fastq_graph_via_adjacency": _with(_EDGES, "SELECT src, dst, label, weight FROM edges"),
    "toml_graph_rc": _with(f"{_READS}, {_WINDOWS}", f"SELECT left(kmer, {K - 1}) AS src, right(kmer, {K - 1}) AS dst, kmer AS label, count(*) AS weight FROM (SELECT kmer FROM win UNION ALL SELECT {_RC.format('kmer')} FROM win) GROUP BY kmer HAVING count(*) >= {THRESHOLD}"),
    "contig_stats_empty": "SELECT CAST(0 AS BIGINT) AS n50, CAST(0 AS BIGINT) AS l50, CAST(0 AS BIGINT) AS n90, CAST(0 AS BIGINT) AS ng50",
    "fasta_graph_rc": _with(f"{_READS}, {_WINDOWS}", f"SELECT kmer, count(*) AS weight FROM (SELECT kmer FROM win UNION ALL SELECT {_RC.format('kmer')} FROM win) GROUP BY kmer"),
    "bfcounter_graph_rc": _with(_BFC, f"SELECT label, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT kmer AS label, weight FROM bfc WHERE weight >= {THRESHOLD} UNION ALL SELECT {_RC.format('kmer')}, weight FROM bfc WHERE weight >= {THRESHOLD}) GROUP BY label"),
}
