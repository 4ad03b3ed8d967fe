"""F1 (molecule producer), SURVEY 2.3.2: linear notation -> node and edge tables.

No per-row parser: the string is cut into tokens with one regex, and every
structural rule is a window over (entity, ...) partitions or an equi join.

1. tokens: ``posexplode(regexp_extract_all(s, TOKEN))``; characters left
   over (token lengths do not add up to the string length) make a row
   invalid.
2. ``depth`` = running count of '(' minus ')'; a negative minimum or a
   non-zero end makes a row invalid.  ``comp`` = running count of '.'
   (disconnected parts).
3. branch of a token = position of the innermost open '(' (-1 for the main
   chain): the last '(' before it whose depth level is still open, found as
   ``last(pos of '(')`` over (entity, comp, depth) partitions.
4. parent of an atom: the previous atom of the same branch (``lag`` over
   (entity, comp, branch)); for the first atom of a branch, the atom that was
   current when the '(' opened (``last`` atom over (entity, comp, depth - 1)
   just before the '('), joined on (entity, branch).
5. ring edges: a ring label belongs to the last atom before it; occurrences
   1-2, 3-4, ... of one label pair up (``row_number`` over (entity, label));
   an unpaired label makes a row invalid; a label right after ')' too.
6. bond kind: the bond token just before the atom or label, else aromatic
   when both ends are lower case, else single.

Windows are per entity: an entity is one molecule-sized string, bounded by
nature; rows of many entities spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The token classes of the linear notation (bracket atom,
# two-letter halogens, organic-subset atoms incl. aromatic lower case, bonds,
# branches, two-digit and one-digit ring labels, dot).
TOKEN = r"\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]|[-=#$:/\\]|\(|\)|%[0-9]{2}|[0-9]|\."
BOND_ORDER = {"-": "single", "=": "double", "#": "triple", "$": "quadruple", ":": "aromatic",
              "/": "single", "\\": "single"}


def _kind(t):
    return (F.when(t == "(", "open").when(t == ")", "close").when(t == ".", "dot")
            .when(t.rlike(r"^(%[0-9]{2}|[0-9])$"), "ring")
            .when(t.rlike(r"^[-=#$:/\\]$"), "bond").otherwise("atom"))


def notation_tokens(df: DataFrame, id_col: str = "entity_id", col: str = "smiles") -> DataFrame:
    """(entity_id, pos, t, kind) plus the per-entity coverage check columns."""
    toks = df.select(F.col(id_col).alias("entity_id"), F.col(col).alias("s"),
                     F.posexplode(F.regexp_extract_all(F.col(col), F.lit(TOKEN), 0)).alias("pos", "t"))
    return toks.withColumn("kind", _kind(F.col("t")))


def notation_graph(df: DataFrame, id_col: str = "entity_id", col: str = "smiles"):
    """-> (nodes, edges, validity).

    nodes (entity_id, node, atom, aromatic); edges (entity_id, src, dst, kind)
    with src < dst; validity (entity_id, is_valid).  Node ids are token
    positions.  Edges and nodes are given for valid entities only.
    """
    tok = notation_tokens(df, id_col, col)
    by_pos = Window.partitionBy("entity_id").orderBy("pos")
    run = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tok = tok.withColumn("step", F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)
                         .otherwise(0)) \
        .withColumn("depth", F.sum("step").over(run)) \
        .withColumn("comp", F.sum((F.col("kind") == "dot").cast("int")).over(run)) \
        .withColumn("prev_kind", F.lag("kind").over(by_pos)) \
        .withColumn("prev_t", F.lag("t").over(by_pos))

    # --- validity: coverage, bracket balance, ring pairing, label after ')'
    cover = tok.groupBy("entity_id").agg(
        F.sum(F.length("t")).alias("covered"), F.first("s").alias("s"),
        F.min("depth").alias("min_depth"), F.max_by("depth", "pos").alias("end_depth"),
        F.count_if((F.col("kind") == "ring") & (F.col("prev_kind") == "close")).alias("bad_labels"))
    # atom-level level: the depth an atom sits at; '(' counts at the level it opens from
    level = F.when(F.col("kind") == "open", F.col("depth") - 1).otherwise(F.col("depth"))
    tok = tok.withColumn("level", level)

    # --- branch of each token: innermost open '(' (its position), -1 on the main chain
    w_lvl = Window.partitionBy("entity_id", "comp", "depth").orderBy("pos") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tok = tok.withColumn("branch", F.when(
        F.col("depth") > 0,
        F.last(F.when(F.col("kind") == "open", F.col("pos")), ignorenulls=True).over(w_lvl))
        .otherwise(F.lit(-1)))
    atoms = tok.filter(F.col("kind") == "atom")

    # parent inside the branch
    w_br = Window.partitionBy("entity_id", "comp", "branch").orderBy("pos")
    atoms = atoms.withColumn("prev_atom", F.lag("pos").over(w_br))
    # atom current when each '(' opened: last atom at the same level before it
    w_head = Window.partitionBy("entity_id", "comp", "level").orderBy("pos") \
        .rowsBetween(Window.unboundedPreceding, -1)
    opens = tok.withColumn("head", F.last(F.when(F.col("kind") == "atom", F.col("pos")),
                                          ignorenulls=True).over(w_head)) \
        .filter(F.col("kind") == "open").select("entity_id", F.col("pos").alias("branch"), "head")
    atoms = atoms.join(opens, ["entity_id", "branch"], "left").withColumn(
        "parent", F.coalesce("prev_atom", F.when(F.col("branch") >= 0, F.col("head"))))

    bond_before = F.when(F.col("prev_kind") == "bond", F.col("prev_t"))
    chain = atoms.filter(F.col("parent").isNotNull()).select(
        "entity_id", F.col("parent").alias("a"), F.col("pos").alias("b"), bond_before.alias("bond"))

    # --- ring closures
    w_last_atom = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    rings = tok.withColumn("owner", F.last(F.when(F.col("kind") == "atom", F.col("pos")),
                                           ignorenulls=True).over(w_last_atom)) \
        .filter(F.col("kind") == "ring") \
        .withColumn("label", F.regexp_replace("t", "%", "")) \
        .withColumn("rn", F.row_number().over(Window.partitionBy("entity_id", "label").orderBy("pos")))
    pairs = rings.groupBy("entity_id", "label", F.floor((F.col("rn") - 1) / 2).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min("owner").alias("a"), F.max("owner").alias("b"),
        F.max(bond_before).alias("bond"))
    unpaired = pairs.filter(F.col("n") != 2).groupBy("entity_id").agg(F.count(F.lit(1)).alias("odd"))
    ring_edges = pairs.filter(F.col("n") == 2).select("entity_id", "a", "b", "bond")

    validity = cover.join(unpaired, "entity_id", "left").select(
        "entity_id",
        ((F.col("covered") == F.length("s")) & (F.col("min_depth") >= 0) & (F.col("end_depth") == 0)
         & (F.col("bad_labels") == 0) & F.col("odd").isNull()).alias("is_valid"))
    # rows whose string is null, empty or has no token at all are invalid too
    all_ids = df.select(F.col(id_col).alias("entity_id"))
    validity = all_ids.join(validity, "entity_id", "left").select(
        "entity_id", F.coalesce("is_valid", F.lit(False)).alias("is_valid"))
    ok = validity.filter("is_valid").select("entity_id")

    atom_case = atoms.select("entity_id", F.col("pos").alias("node"), F.col("t").alias("atom"),
                             F.col("t").rlike(r"^(\[)?[a-z]").alias("aromatic"))
    nodes = atom_case.join(ok, "entity_id", "left_semi")
    arom = atom_case.select("entity_id", "node", "aromatic")
    edges = chain.unionByName(ring_edges).join(ok, "entity_id", "left_semi")
    edges = edges.join(arom.withColumnRenamed("node", "a").withColumnRenamed("aromatic", "ar_a"),
                       ["entity_id", "a"]) \
        .join(arom.withColumnRenamed("node", "b").withColumnRenamed("aromatic", "ar_b"), ["entity_id", "b"])
    kind = F.coalesce(
        F.element_at(F.create_map(*[x for kv in BOND_ORDER.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                     F.col("bond")),
        F.when(F.col("ar_a") & F.col("ar_b"), F.lit("aromatic")).otherwise(F.lit("single")))
    edges = edges.select("entity_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"),
                         kind.alias("kind"))
    return nodes, edges, validity
