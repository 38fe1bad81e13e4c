"""Further queries: letters and numbers, statistics, geometry of chains, the store, and reports read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions import alphabet as A
from foldline.functions import geometry as G
from foldline.functions import statistics as S
from foldline.functions.alphabet import PROFILE_ORDER
from foldline.functions.deflines import QUERY_LINE, query_defline
from foldline.operators import msa
from foldline.operators.cluster import clustered
from foldline.operators.search import DUST, seg_mask_with
from foldline.operators.sheets import ladders, sheets, statistics, strongest
from foldline.operators.store import counted, exported, looked_up, same_as
from foldline.plans import report
from foldline.plans.queries import BRIDGE_SQL, DOCS, ITEMS, _bonds, _bridges, _dist, _p, by_user, chain_residues, documents, items, query, table
from foldline.sources import stockholm as sto

# -- letters, names and numbers ---------------------------------------------------------------


@query(f"with {ITEMS} select id, replace(seq, 'A', '-') || '.' as letters, length(seq) + 1 as n from items")
def letter_round_trip(spark, d):
    """Letters to numbers and back: gaps come back as -, anything else unknown as a point."""
    codes = A.encoded(F.concat(F.replace("seq", F.lit("A"), F.lit("-")), F.lit("?")))
    return items(spark, d).select("id", A.decoded(codes).alias("letters"), F.size(codes).cast("long").alias("n"))


_THREE = A.THREE.split()
_NAMES = " ".join(f"when '{n}' then '{c}' when '{c}' then '{c}'" for n, c in zip(_THREE[::2], _THREE[1::2], strict=True))


@query(f"select p_partkey, case upper(substring(p_name, 1, 3)) {_NAMES} else 'X' end as letter, upper(trim(substring(p_type, 1, 2))) in ('H', 'C', 'N', 'O', 'F', 'P', 'S', 'CL', 'K', 'CA', 'ZN', 'SE', 'MG') as known from part")
def residue_names(spark, d):
    """Residue names to letters and element names to known ones."""
    return table(spark, d, "part").select("p_partkey", A.residue_of(F.upper(F.substring("p_name", 1, 3))).alias("letter"), A.known_element(F.substring("p_type", 1, 2)).alias("known"))


@query("""with t as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then ' ' when 1 then ' +' || cast(l_quantity as integer) || '.5' when 2 then cast(cast(l_quantity as integer) as varchar) || 'e1' else '-' || cast(l_linenumber as varchar) end as s from lineitem)
select l_orderkey, l_linenumber, case when trim(s) = '' then 0.0 when regexp_full_match(trim(s), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]*)') then cast(trim(s) as double) end as v from t""")
def plain_floats(spark, d):
    """Numbers as structure files have them; exponents aren't numbers."""
    whole, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    s = F.when(k == 0, " ").when(k == 1, F.concat(F.lit(" +"), whole, F.lit(".5"))).when(k == 2, F.concat(whole, F.lit("e1"))).otherwise(F.concat(F.lit("-"), F.col("l_linenumber").cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.plain_float(s).alias("v"))


@query("select user_id, string_agg(upper(substring(event_type, 1, 1)), '' order by ts, event_id) as seq from events group by 1")
def chain_sequences(spark, d):
    """The letters of a chain in order; a chain's residues are one row."""
    letters = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.upper(F.substring("event_type", 1, 1)).alias("c"))))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(letters, lambda x: x["c"]), "").alias("seq"))


@query(f"""with t as (select p_partkey, p_brand, case p_partkey % 4 when 0 then '>sp|P' || p_partkey || '|' || replace(p_brand, '#', '_') || ' ' || p_name || chr(10) when 1 then '>word ' || p_name || chr(10) when 2 then '>part' || p_partkey || chr(10) else '' end || p_type || chr(10) || p_name as s from part)
select p_partkey, case when not starts_with(s, '>') then 'query' when regexp_matches(s, '{QUERY_LINE}') then case when regexp_extract(s, '{QUERY_LINE}', 3) <> '' then regexp_extract(s, '{QUERY_LINE}', 3) else regexp_extract(s, '{QUERY_LINE}', 1) end else regexp_extract(split_part(s, chr(10), 1), '^>([^ ]*)', 1) end as id,
case when not starts_with(s, '>') then '' when regexp_matches(s, '{QUERY_LINE}') then regexp_extract(s, '{QUERY_LINE}', 6) else regexp_extract(split_part(s, chr(10), 1), '^>[^ ]* (.*)$', 1) end as descr,
case when not starts_with(s, '>') then s when regexp_matches(s, '{QUERY_LINE}') then regexp_replace(s, '{QUERY_LINE}', '') else substring(s, length(split_part(s, chr(10), 1)) + 2) end as seq from t""")
def query_deflines(spark, d):
    """Names, descriptions and sequences of queries with and without a line for them."""
    k, end = F.col("p_partkey"), F.lit("\n")
    line = F.when(k % 4 == 0, F.concat(F.lit(">sp|P"), k, F.lit("|"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit(" "), F.col("p_name"), end)).when(k % 4 == 1, F.concat(F.lit(">word "), F.col("p_name"), end)).when(k % 4 == 2, F.concat(F.lit(">part"), k, end)).otherwise("")
    text = F.concat(line, F.col("p_type"), end, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", query_defline(text).alias("q")).select("p_partkey", "q.*")


# -- statistics of searches -------------------------------------------------------------------

_SPACE = "0.041 * (m - l) * (n - c * l)"


@query(f"""with {ITEMS}, s as (select count(*) as c, cast(sum(length(seq)) as double) as n from items), q as (select distinct p_size + 20 as m from part),
f as (select m, c, n, unnest(generate_series(0, m - 1)) as l from q, s), ok as (select m, c, n, l from f where c * l < n and {_SPACE} > greatest(cast(m as double), n) and -30.0 + 1.9 / 0.267 * ln(greatest({_SPACE}, 1e-9)) >= l)
select q.m as query_length, cast(coalesce(max(l), 0) as bigint) as adjustment, cast((q.m - coalesce(max(l), 0)) * (max(s.n) - max(s.c) * coalesce(max(l), 0)) as bigint) as space from q cross join s left join ok on ok.m = q.m group by q.m""")
def length_adjustment(spark, d):
    """By how much queries of some lengths are shortened against the items, and the search space that is left."""
    stats = items(spark, d).agg(F.count("*").alias("c"), F.sum(F.length("seq")).alias("n"))
    q = table(spark, d, "part").select((F.col("p_size") + 20).cast("long").alias("query_length")).distinct()
    t = q.join(F.broadcast(stats))  # one row
    return t.select("query_length", S.length_adjustment(F.col("query_length"), F.col("n"), F.col("c")).alias("adjustment"), S.search_space(F.col("query_length"), F.col("n"), F.col("c")).cast("long").alias("space"))


@query()
def merged_hits(spark, d):
    """Overlapping partial hits of a pair: the better ones stay, those expected too often go, pairs without any go."""
    hsp = F.struct((F.col("l_quantity") * 4).cast("long").alias("score"), F.col("l_linenumber").cast("long").alias("q_start"), (F.col("l_linenumber") + F.col("l_partkey") % 9).cast("long").alias("q_end"), (F.col("l_suppkey") % 40).alias("t_start"), (F.col("l_suppkey") % 40 + F.col("l_partkey") % 9).alias("t_end"))
    pairs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(hsp).alias("hsps"))
    kept = pairs.select("l_orderkey", S.merged_hits(F.col("hsps"), F.lit(1e9), 10.0).alias("hsps")).filter(F.size("hsps") > 0)
    return kept.select("l_orderkey", F.posexplode("hsps").alias("nr", "h")).select("l_orderkey", "nr", "h.*")


@query()
def dust_masked(spark, d):
    """Items with the wide window for low complexity."""
    return items(spark, d).select("id", F.length("seq").alias("n"), seg_mask_with(DUST)("seq").alias("masked"))


@query("""with t as (select event_id, user_id, ts, value, case event_type when 'click' then 'H' when 'error' then 'G' when 'view' then 'T' else ' ' end as ss, row_number() over w as pos, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by ts, event_id)),
u as (select *, case when value < 5 then 3 else 0 end as gaps, least(8, """ + ", ".join(f"case when pos + {k} > n or pos - {k} < 1 or lead(value, {k}) over w < 5 or lag(value, {k}) over w < 5 then {k} else 8 end" for k in range(8)) + """) as near from t window w as (partition by user_id order by ts, event_id))
select event_id, round(10.0 * case ss when 'H' then 2 when 'G' then 3 when 'T' then 1.5 else 1 end * case when value > 270 then 0 else 1 end * case when near < 8 then (2 + (8 - near) * 2) / 8.0 else 1 end, 6) as open_cost, round(case when gaps > 0 then gaps / 11.0 else 0.5 end, 6) as extend_cost from u""")
def gap_costs(spark, d):
    """Costs of gaps by column: state, insertions there, gaps in the rows, and the nearest gap or end."""
    w = by_user()
    t = table(spark, d, "events")
    ss = F.when(F.col("event_type") == "click", "H").when(F.col("event_type") == "error", "G").when(F.col("event_type") == "view", "T").otherwise(" ")
    rows = t.select("event_id", "user_id", F.row_number().over(w).alias("pos"), ss.alias("ss"), F.when(F.col("value") > 270, 1).otherwise(0).alias("inserted"), F.when(F.col("value") < 5, 3).otherwise(0).alias("gaps"))
    return msa.column_gap_costs(rows, "user_id", F.lit(11), 10.0, 0.5).select("event_id", F.round("open_cost", 6).alias("open_cost"), F.round("extend_cost", 6).alias("extend_cost"))


# -- geometry of chains -----------------------------------------------------------------------


def _dihedral(p1: str, p2: str, p3: str, p4: str) -> str:
    v, u, z = ({c: f"({a}{c} - {b}{c})" for c in "xyz"} for a, b in ((p1, p2), (p4, p3), (p2, p3)))

    def cross(a, b):
        return {"x": f"({a['y']} * {b['z']} - {b['y']} * {a['z']})", "y": f"({a['z']} * {b['x']} - {b['z']} * {a['x']})", "z": f"({a['x']} * {b['y']} - {b['x']} * {a['y']})"}

    def dot(a, b):
        return "(" + " + ".join(f"{a[c]} * {b[c]}" for c in "xyz") + ")"

    p, x = cross(z, v), cross(z, u)
    y = cross(z, x)
    return f"degrees(atan2({dot(p, y)} / sqrt({dot(y, y)}), {dot(p, x)} / sqrt({dot(x, x)})))"


_NEAR = ", ".join(f"{f}({n}{c}) over w as {k}{n}{c}" for f, k, n in (("lag", "b", "c"), ("lag", "b", "o"), ("lead", "f", "n")) for c in "xyz")
_CO = "(({0}) / sqrt(({1}) * ({2})))".format(" + ".join(f"(c{k} - o{k}) * (bc{k} - bo{k})" for k in "xyz"), " + ".join(f"(c{k} - o{k}) * (c{k} - o{k})" for k in "xyz"), " + ".join(f"(bc{k} - bo{k}) * (bc{k} - bo{k})" for k in "xyz"))


@query(f"""with {_p()}, t as (select *, {_NEAR} from p window w as (partition by chain order by vec_id))
select vec_id, round(case when bcx is null or {_dist('bc', 'n')} > 12 then 360.0 else {_dihedral('bc', 'n', 'ca', 'c')} end, 4) as phi, round(case when fnx is null or {_dist('c', 'fn')} > 12 then 360.0 else {_dihedral('n', 'ca', 'c', 'fn')} end, 4) as psi,
round(case when bcx is null or {_dist('bc', 'n')} > 12 then 0.0 else {_CO} end, 6) + 0.0 as tco from t""")
def torsions(spark, d):
    """Phi, psi and the angle between neighbouring C=O; 360 and 0 at the ends of unbroken stretches."""
    w = Window.partitionBy("chain").orderBy("vec_id")
    t = chain_residues(spark, d).withColumn("bc", F.lag("c").over(w)).withColumn("bo", F.lag("o").over(w)).withColumn("fn", F.lead("n").over(w))
    c = F.col
    before = c("bc").isNotNull() & (G.distance(c("bc"), c("n")) <= 12)
    after = c("fn").isNotNull() & (G.distance(c("c"), c("fn")) <= 12)
    phi = F.when(before, G.dihedral(c("bc"), c("n"), c("ca"), c("c"))).otherwise(360.0)
    psi = F.when(after, G.dihedral(c("n"), c("ca"), c("c"), c("fn"))).otherwise(360.0)
    tco = F.when(before, G.cosine(c("c"), c("o"), c("bc"), c("bo"))).otherwise(0.0)
    return t.select("vec_id", F.round(phi, 4).alias("phi"), F.round(psi, 4).alias("psi"), (F.round(tco, 6) + 0.0).alias("tco"))


@query(f"with {_p()} select chain, count(*) as n, round(avg(cax), 6) as x, round(avg(cay), 6) as y, round(avg(caz), 6) as z, round(sqrt(avg((cax - nx) * (cax - nx) + (cay - ny) * (cay - ny) + (caz - nz) * (caz - nz))), 6) as rmsd from p group by 1")
def centroids(spark, d):
    """Centroid of each chain and the root mean square distance of two of its atoms as they stand."""
    gap = G.distance(F.col("ca"), F.col("n"))
    return chain_residues(spark, d).groupBy("chain").agg(F.count("*").alias("n"), *[F.round(F.avg(f"ca.{c}"), 6).alias(c) for c in "xyz"], F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmsd"))


@query()
def superposition(spark, d):
    """The least such distance after the best rotation, and the rotation's angle."""
    s = G.superposed(chain_residues(spark, d).select("chain", "ca", "n"), "chain", "ca", "n")
    return s.select("chain", "n", F.round("rmsd", 4).alias("rmsd"), F.round(G.angle_axis(F.col("quaternion"))["angle"], 2).alias("angle"))


@query(f"""with {_p()} select vec_id, {' and '.join(f"o{c} + 1.5 >= least(ca{c}, n{c}) - 3.0 and o{c} - 1.5 <= greatest(ca{c}, n{c}) + 3.0" for c in 'xyz')} as inside from p""")
def box_hits(spark, d):
    """Whether an atom's sphere reaches into a residue's box."""
    lo, hi = ({c: f(F.col(f"ca.{c}"), F.col(f"n.{c}")) for c in "xyz"} for f in (F.least, F.greatest))
    return chain_residues(spark, d).select("vec_id", G.touches(G.grown(lo, hi, 3.0), F.col("o"), F.lit(1.5)).alias("inside"))


@query()
def ladder_histograms(spark, d):
    """How many ladders have how many bridges, by kind, and how many sheets have how many ladders; the 30th bin takes the rest.

    A sheet of one ladder counts if the ladder has more than one bridge.
    """
    found = sheets(ladders(_bridges(spark, d)))
    per = found.groupBy(F.col("kind").alias("what"), F.least("n", F.lit(30)).alias("size")).agg(F.count("*").alias("times"))
    own = found.groupBy("protein", "sheet").agg(F.count("*").alias("k"), F.max("n").alias("longest")).filter("k > 1 or longest > 1")
    return per.unionByName(own.groupBy(F.lit("sheet").alias("what"), F.least("k", F.lit(30)).alias("size")).agg(F.count("*").alias("times")))


# -- the store --------------------------------------------------------------------------------


@query()
def near_chain_clusters(spark, d):
    """Each item as a protein of four chains: itself, its end, itself backwards, itself."""
    t = items(spark, d).select("id", F.posexplode(F.array("seq", F.substring("seq", 4, 1 << 30), F.reverse("seq"), "seq")).alias("nr", "seq"))
    return clustered(t, "id")


@query(f"with {DOCS} select md5(seq) as seq_md5, string_agg(cast(id as varchar), ',' order by id) as ids from docs group by 1 having count(*) > 1")
def same_sequences(spark, d):
    """The ids of equal sequences; the groups that have several. Their lists are one row a group."""
    return same_as(documents(spark, d).select("id", F.md5("seq").alias("seq_md5")), "seq_md5", "id").select("seq_md5", F.array_join(F.transform("ids", lambda k: k.cast("string")), ",").alias("ids"))


@query("select l_orderkey, l_linenumber, p_name, s_name from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey")
def store_lookup(spark, d):
    """Codes to sequences to clusters by their keys."""
    codes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    named = looked_up(looked_up(codes, table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey"), table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return named.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("select c_custkey, nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer where nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY'")
def store_export(spark, d):
    """Rows whose value is known and not the one named."""
    t = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return exported(t, "c_mktsegment", "MACHINERY")


@query("select c_mktsegment, count(*) as n from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1")
def code_counts(spark, d):
    return counted(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])


_OFFSETS = ", ".join(f"count(*) filter (where k = {k}) as {f'minus_{-k}' if k < 0 else f'plus_{k}'}" for k in range(-5, 6))


@query(f"""with {BRIDGE_SQL}, rows as (select chain as protein, 1 as residue, null as k from r union all select protein, null, a - d from best)
select coalesce(cast(protein as varchar), 'all') as protein, count(residue) as residues, count(distinct case when residue = 1 then protein end) as chains, count(k) as bonds, {_OFFSETS} from rows group by rollup(rows.protein)""")
def structure_statistics(spark, d):
    """Residues, chains and strong bonds of proteins, and how far apart the bonds' ends are in the chain."""
    best = strongest(_bonds(spark, d).select("protein", F.col("d").alias("donor"), F.col("a").alias("acceptor"), "energy"))
    found = statistics(best, chain_residues(spark, d).select(F.col("chain").alias("protein"), F.lit(1).alias("segment")))
    return found.withColumn("protein", F.coalesce(F.col("protein").cast("string"), F.lit("all")))


# -- reports, and reading them back -----------------------------------------------------------

QUERIES_OF = 4
_PAIRS = f"""{ITEMS}, q as (select id as k, seq as query from items where id < {QUERIES_OF} and length(seq) > 0),
h as (select 'q' || k as query_id, 'h' || id as id, id as item, seq, query, rpad(substring(seq, 1, length(query)), cast(length(query) as integer), '.') as aligned from items join q on k = id % {QUERIES_OF} where id >= {QUERIES_OF} and length(seq) > 0)"""


def report_tables(spark, d):
    """The first items as queries with chains and residues, the others as their hits."""
    t = items(spark, d).filter("length(seq) > 0")
    q = t.filter(F.col("id") < QUERIES_OF).select(F.col("id").alias("k"), F.concat(F.lit("q"), "id").alias("query_id"), F.col("seq").alias("query"))
    h = t.filter(F.col("id") >= QUERIES_OF).join(F.broadcast(q), F.col("id") % QUERIES_OF == F.col("k"))
    n = F.length("query")
    hits = h.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("nr"), F.concat(F.lit("h"), "id").alias("id"), F.concat(F.lit("ACC"), "id").alias("accession"), F.lit("an item").alias("descr"), F.lit(0.5).alias("score"), F.lit(0.25).alias("similarity"), F.lit(1).alias("ifir"), F.least(n, F.length("seq")).alias("ilas"), F.lit(1).alias("jfir"), F.least(n, F.length("seq")).alias("jlas"), F.least(n, F.length("seq")).alias("length"), F.lit(0).alias("gaps"), F.lit(0).alias("gap_letters"), F.length("seq").alias("seq_len"), F.array().cast("array<string>").alias("pdbs"), F.expr("rpad(substring(seq, 1, length(query)), length(query), '.')").alias("aligned"))
    queries = q.select("query_id", F.lit("2020-01-01").alias("date"), F.upper("query_id").alias("pdb_id"), F.lit("HEAD").alias("header"), F.lit("").alias("compound"), F.lit("").alias("source"), F.lit("someone").alias("author"), F.array(F.lit("DBREF  x")).alias("dbrefs"), F.lit("A").alias("chain"), F.lit(3).alias("n_chains"), F.array(F.lit("A")).alias("used"), F.array(F.lit("B"), F.lit("C")).alias("same"), F.col("query").alias("aligned"))
    cells = q.select("query_id", F.posexplode(F.split("query", "")).alias("k", "letter")).filter("letter <> ''")
    seq_nr = F.col("k") + 1 + (F.col("k") >= 30).cast("int")
    state = F.when(F.col("k") % 5 == 0, "H").otherwise(" ")
    residues = cells.select("query_id", (F.col("k") + 1).alias("pos"), seq_nr.alias("seq_nr"), (F.col("k") + 10).alias("pdb_nr"), F.lit(" ").alias("icode"), F.lit("A").alias("chain"), F.lit("A").alias("auth_chain"), "letter", F.lit(0).alias("bridge"), state.alias("ss"), F.lit(None).cast("int").alias("none"), F.lit(0).alias("bp1"), (F.col("k") % 50).alias("bp2"), (F.col("k") % 200 + 0.5).alias("accessibility"), F.lit(7).alias("nocc"), F.lit(1).alias("ndel"), F.lit(2).alias("nins"), F.lit(0.5).alias("entropy"), F.lit(0.25).alias("weight"), F.create_map("letter", F.lit(1.0)).alias("freq"))
    flags = [F.lit(" "), F.lit(">"), F.lit(" ")]
    residues = residues.withColumn("structure", report.structure_string(F.col("ss"), flags, F.lit(True), F.lit("+"), [F.col("bp2"), F.col("none")], [F.lit(True), F.lit(False)]))
    return queries, residues, hits


def report_lines(spark, d):
    """(file, line_no, value) of the reports."""
    queries, residues, hits = report_tables(spark, d)
    lines = report.stockholm(queries, residues, hits, residues)
    nr = F.row_number().over(Window.partitionBy("query_id").orderBy(*report.ORDER))
    return lines.select(F.col("query_id").alias("file"), nr.alias("line_no"), F.col("line").alias("value"))


@query(f"with {_PAIRS} select query_id, id, 'ACC' || item as accession, 'an item' as descr, 0.5::double as score, least(length(query), length(seq)) as length, cast(length(seq) as bigint) as seq_len, aligned from h union all select 'q' || k, 'q' || k, '', '', 0.0, 0, 0, query from q")
def report_hits_read_back(spark, d):
    """The hits and rows of alignment that the reports' lines say."""
    rows = sto.blocks(report_lines(spark, d))
    got = sto.aligned(rows).join(sto.hits(rows).drop("query_id"), ["file", "block", "id"], "left")
    return got.select("query_id", "id", "accession", "descr", "score", "length", "seq_len", "aligned").na.fill("", ["accession", "descr"]).na.fill(0, ["score", "length", "seq_len"])


@query(f"""with {_PAIRS}, r as (select k, query, unnest(generate_series(1, length(query))) as pos from q)
select 'q' || k as query_id, pos + case when pos > 30 then 1 else 0 end as seq_nr, pos + 9 as pdb_nr, substring(query, pos, 1) as letter, case when (pos - 1) % 5 = 0 then 'H' else ' ' end || '  > S+' || chr(cast(97 + (pos - 1) % 50 % 26 as integer)) || ' ' as structure,
(pos - 1) % 50 as bp2, (pos - 1) % 200 + 1 as accessibility, 75 as variability from r""")
def report_residues_read_back(spark, d):
    t = sto.residues(sto.blocks(report_lines(spark, d))).filter("not is_break")
    return t.select(F.col("file").alias("query_id"), "seq_nr", "pdb_nr", "letter", "structure", "bp2", "accessibility", "variability")


@query(f"with {_PAIRS} select 'q' || k as query_id, 'Q' || k as pdb_id, 'HEADER     HEAD' || chr(10) || 'AUTHOR     someone' || chr(10) || 'DBREF      x' as description, 'B,C' as same from q")
def report_heads_read_back(spark, d):
    return sto.heads(sto.blocks(report_lines(spark, d))).select("query_id", "pdb_id", "description", F.array_join("same", ",").alias("same"))


@query(f"""with {_PAIRS}, r as (select k, query, unnest(generate_series(1, length(query))) as pos from q)
select 'q' || k as query_id, pos + case when pos > 30 then 1 else 0 end as seq_nr, case when instr('{PROFILE_ORDER}', substring(query, pos, 1)) > 0 then substring(query, pos, 1) else '' end as letters,
7 as nocc, 1 as ndel, 2 as nins, 0.5::double as entropy, 16 as relent, 0.25::double as weight from r""")
def report_profile_read_back(spark, d):
    """The profile lines' numbers, and the residues that have all of a column."""
    t = sto.profiles(sto.blocks(report_lines(spark, d))).filter("weight < 1")
    letters = F.array_join(F.filter(F.map_keys("shares"), lambda c: F.col("shares")[c] == 100), "")
    return t.select(F.col("file").alias("query_id"), "seq_nr", letters.alias("letters"), "nocc", "ndel", "nins", "entropy", "relent", "weight")


@query(f"""with {_PAIRS} select 'q' || k as file, case k when 0 then 'not in the header: stray' when 1 then 'truncated or incomplete' when 2 then 'a profile line without its residue' else 'empty id in an alignment line' end as fault from q
union all select 'q' || k, 'invalid residue ' || substring(query, 1, 1) || ' expected to be ?' from q where substring(query, 1, 1) <> 'C'""")
def report_faults(spark, d):
    """Reports with one fault each, and in all of them a residue line with a wrong letter."""
    lines = report_lines(spark, d).filter("value <> '//' or file <> 'q1'")
    v = F.col("value")
    lines = lines.withColumn("value", F.when(v.startswith("#=GF RI     1 "), F.overlay(v, F.lit("?"), F.lit(23))).otherwise(v))
    extra = lines.filter(F.col("value").startswith("#=GF ID ")).select("file", "line_no", F.when(F.col("file") == "q0", "stray  A").when(F.col("file") == "q2", "#=GF PR 99999 99999 A").when(F.col("file") == "q3", " nobody  A").alias("value"))
    return sto.faults(sto.blocks(lines.unionByName(extra.filter("value is not null")))).select("file", "fault")


@query()
def legacy_report(spark, d):
    """The older format, from what the new one says."""
    rows = sto.blocks(report_lines(spark, d))
    heads, res, al = sto.heads(rows), sto.residues(rows), sto.aligned(rows)
    proteins = heads.join(res.groupBy("file", "block").agg(F.count_if(~F.col("is_break")).alias("seq_length")), ["file", "block"]).select("query_id", "pdb_id", "description", "seq_length", (F.size("same") + 1).alias("n_chain"), F.array(F.lit("A")).alias("used"))
    hits = sto.hits(rows).join(rows.select("file", "block", "query_id").distinct(), ["file", "block"]).withColumnRenamed("score", "identity")
    both = al.filter("id <> query_id").join(al.filter("id = query_id").select("query_id", F.col("aligned").alias("query")), "query_id")
    spans = both.join(hits.select("query_id", "id", "ifir", "jfir"), ["query_id", "id"])
    cells = both.select("query_id", "id", F.posexplode(F.split("aligned", "")).alias("k", "letter")).filter("letter <> ''").select("query_id", "id", (F.col("k") + 1).alias("nr"), "letter")
    text = rows.filter(F.col("value").startswith("#=GF RI ")).select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("line_no")).alias("nr"), F.substring("value", 14, 43).alias("text"))
    return report.legacy(proteins, text, hits, cells, sto.insertions(spans))
