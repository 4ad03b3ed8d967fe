"""Independent DuckDB SQL for every query that SQL can express.

Each string runs on the pre-registered views ``region nation customer
supplier part orders lineitem events documents embeddings pages benchmark
labels conversations`` and returns the same columns, rounded the same way, as
the Spark query of the same key in ``scorelens.plans.queries``.
Shared pieces are CTE strings composed below.
"""

from __future__ import annotations

# ---------------------------------------------------------------- shared CTEs

FOLDS = """
folds AS (
  SELECT doc_id, label,
         (row_number() OVER (ORDER BY label, md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 + 1
           AS fold
  FROM (SELECT l.doc_id, l.toxic AS label
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id
        WHERE l.toxic IS NOT NULL) t
)"""

SCORED = FOLDS + """,
scored AS (
  SELECT d.doc_id, d.lang AS model, f.fold, CAST(f.label AS INTEGER) AS y_true,
         CAST(d.n_chars % 50 AS DOUBLE) / 50 AS y_prob
  FROM documents d JOIN folds f ON d.doc_id = f.doc_id
)"""

SCORED_LINEITEM = """
scored AS (
  SELECT l_linestatus AS model,
         CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
         l_discount * 10 AS y_prob
  FROM lineitem
)"""


def _cls(group: str) -> str:
    return f"""
cls AS (
  SELECT {group}, count(*) AS n,
         count_if(y_true = 1 AND y_prob > 0.5) AS tp,
         count_if(y_true = 0 AND y_prob > 0.5) AS fp,
         count_if(y_true = 0 AND y_prob <= 0.5) AS tn,
         count_if(y_true = 1 AND y_prob <= 0.5) AS fn
  FROM scored GROUP BY {group}
)"""


def _cum(group: str) -> str:
    return f"""
dist AS (
  SELECT {group}, y_prob AS score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg
  FROM scored GROUP BY {group}, y_prob
),
cum AS (
  SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
         sum(pos) OVER (PARTITION BY {group}) AS P,
         sum(neg) OVER (PARTITION BY {group}) AS N
  FROM dist
  WINDOW w AS (PARTITION BY {group} ORDER BY score DESC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def _rank(group: str) -> str:
    return f"""
rnk AS (
  SELECT {group},
         CASE WHEN max(P) > 0 AND max(N) > 0 THEN
           CAST(sum(pos * (2 * (N - cum_neg) + neg)) AS DOUBLE)
             / (2.0 * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) END AS roc_auc,
         CASE WHEN max(P) > 0 THEN
           sum(pos * cum_pos / (cum_pos + cum_neg)) / CAST(max(P) AS DOUBLE) END AS pr_auc
  FROM cum GROUP BY {group}
)"""


CLS_COLUMNS = """
  round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0
             THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2
             WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn)
             WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
             ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1"""


def _metrics(scored_cte: str, group_cols: list[str]) -> str:
    g = ", ".join(group_cols)
    join = " AND ".join(f"c.{c} = r.{c}" for c in group_cols)
    sel = ", ".join(f"c.{c}" for c in group_cols)
    return f"""WITH {scored_cte},{_cls(g)},{_cum(g)},{_rank(g)}
SELECT {sel}, c.n, {CLS_COLUMNS},
       round(r.roc_auc, 6) AS roc_auc, round(r.pr_auc, 6) AS pr_auc
FROM cls c JOIN rnk r ON {join}"""


ORACLES: dict[str, str] = {}

ORACLES["stratified_folds"] = f"""WITH {FOLDS}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(label AS BIGINT) AS label, CAST(fold AS BIGINT) AS fold
FROM folds"""

ORACLES["stratified_fold_counts"] = f"""WITH {FOLDS}
SELECT CAST(fold AS BIGINT) AS fold, CAST(label AS BIGINT) AS label, count(*) AS n
FROM folds GROUP BY fold, label"""

ORACLES["metrics_fold"] = _metrics(SCORED, ["model", "fold"])

ORACLES["metrics_lineitem"] = _metrics(SCORED_LINEITEM, ["model"])

# ------------------------------------------------------------------ cleaning

VALID = r"""(regexp_matches(text, '\S')
            AND length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', ''))
            AND length(text) = n_chars)"""

ORACLES["validity_split"] = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce({VALID}, false) AS is_valid FROM documents"""

ORACLES["validity_counts"] = f"""
SELECT count(*) AS n_total, CAST(count_if(coalesce({VALID}, false)) AS BIGINT) AS n_valid,
       CAST(count_if(NOT coalesce({VALID}, false)) AS BIGINT) AS n_dropped
FROM documents"""

ORACLES["sample_id"] = """
SELECT CAST(d.doc_id AS BIGINT) AS doc_id,
       coalesce(CASE WHEN l.doc_id IS NOT NULL THEN d.source END, 'sample_' || CAST(d.doc_id AS VARCHAR))
         AS sample_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

ORACLES["split_xy"] = """
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(l.toxic AS BIGINT) AS label, d.lang, d.source, d.n_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL"""

ORACLES["label_encode"] = """
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code
FROM events"""

ORACLES["label_distribution"] = """
SELECT CAST(toxic AS BIGINT) AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic"""

ORACLES["class_weights"] = """
WITH c AS (SELECT CAST(toxic AS BIGINT) AS label, count(*) AS n_c FROM labels
           WHERE toxic IS NOT NULL GROUP BY toxic)
SELECT label, n_c,
       round(CAST((SELECT sum(n_c) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n_c), 6) AS weight
FROM c"""

# ------------------------------------------------------------------ tokens and fingerprints

def toks(source: str = "documents") -> str:
    return rf"""
toks AS (
  SELECT CAST(s.doc_id AS BIGINT) AS doc_id, CAST(u.pos - 1 AS BIGINT) AS pos,
         u.t AS tok_raw, lower(u.t) AS tok
  FROM {source} s, unnest(regexp_split_to_array(s.text, '[ \n]+')) WITH ORDINALITY AS u(t, pos)
  WHERE u.t <> ''
)"""


EDGES = """
edges AS (
  SELECT * FROM (
    SELECT doc_id, pos AS src_pos, lead(pos) OVER w AS dst_pos, tok AS src_tok, lead(tok) OVER w AS dst_tok,
           length(tok_raw) AS src_len, lead(length(tok_raw)) OVER w AS dst_len
    FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) e
  WHERE dst_pos IS NOT NULL
)"""

ORACLES["token_graph"] = f"""WITH {toks()}, {EDGES}
SELECT doc_id, src_pos, dst_pos, src_tok, dst_tok FROM edges"""


def envs(radius: int, fragments: bool = False) -> str:
    """Identifiers h0..hR per token, then one row per (token, radius)."""
    parts = ["h0 AS (SELECT doc_id, pos, tok, substr(md5(tok), 1, 8) AS h0 FROM toks)"]
    for r in range(1, radius + 1):
        p = f"h{r - 1}"
        parts.append(
            f"h{r} AS (SELECT *, substr(md5(coalesce(lag({p}) OVER w, '') || ' ' || {p} || ' ' || "
            f"coalesce(lead({p}) OVER w, '')), 1, 8) AS h{r} FROM {p} "
            f"WINDOW w AS (PARTITION BY doc_id ORDER BY pos))")
    last = f"h{radius}"
    if fragments:
        frs = []
        for r in range(radius + 1):
            items = [f"lag(tok, {k}) OVER w" for k in range(r, 0, -1)] + ["tok"] + \
                    [f"lead(tok, {k}) OVER w" for k in range(1, r + 1)]
            frs.append(f"concat_ws(' ', {', '.join(items)}) AS f{r}")
        parts.append(f"fr AS (SELECT *, {', '.join(frs)} FROM {last} "
                     f"WINDOW w AS (PARTITION BY doc_id ORDER BY pos))")
        last = "fr"
    sel = " UNION ALL ".join(
        f"SELECT doc_id, pos, {r} AS radius, h{r} AS ident"
        + (f", f{r} AS fragment" if fragments else "") + f" FROM {last}"
        for r in range(radius + 1))
    parts.append(f"envs0 AS ({sel})")
    parts.append("envs AS (SELECT *, CAST(('0x' || ident)::BIGINT % 1024 AS BIGINT) AS bit FROM envs0)")
    return ",\n".join(parts)


ORACLES["fingerprint_r1"] = f"""WITH {toks()}, {envs(1)}
SELECT DISTINCT doc_id, bit FROM envs"""

ORACLES["fingerprint_r3"] = f"""WITH {toks()}, {envs(3)}
SELECT DISTINCT doc_id, bit FROM envs"""

LABELLED = """
labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL
)"""

FP_TABLE = f"""{LABELLED}, {toks('labelled')}, {envs(3)},
bits AS (SELECT DISTINCT doc_id, bit FROM envs),
fpt AS (
  SELECT CAST(l.doc_id AS BIGINT) AS doc_id, l.source AS name, CAST(l.label AS BIGINT) AS label,
         count(b.bit) AS n_on, coalesce(string_agg(CAST(b.bit AS VARCHAR), ',' ORDER BY b.bit), '') AS bits,
         coalesce(sum(b.bit), 0) AS bit_sum
  FROM labelled l LEFT JOIN bits b ON l.doc_id = b.doc_id
  GROUP BY l.doc_id, l.source, l.label
)"""

ORACLES["fingerprint_table"] = f"""WITH {FP_TABLE}
SELECT doc_id, name, label, n_on, bits FROM fpt"""

ORACLES["fingerprint_width"] = f"""WITH {FP_TABLE}
SELECT doc_id, CAST(1024 AS BIGINT) AS width, n_on, CAST(bit_sum AS BIGINT) AS checksum FROM fpt"""

# ------------------------------------------------------------------ descriptors

WEIGHTS = """
weights AS (
  SELECT * FROM (VALUES
    (1, -0.5, 1.0, 12.0, 3.5), (2, -0.25, 2.5, 9.0, 5.0), (3, 0.125, 4.0, 6.0, 6.5),
    (4, 0.25, 5.5, 3.0, 8.0), (5, 0.5, 7.0, 1.5, 9.5), (6, 0.75, 8.5, 0.5, 11.0),
    (7, 0.875, 10.0, 0.0, 12.5), (8, 1.25, 12.0, 0.0, 15.0)
  ) t(type, log_p, mol_mr, tpsa, labute_asa)
)"""


def descriptor_ctes(source: str, with_toks: bool = True) -> str:
    """CTE chain ending in ``desc0(doc_id, <15 descriptors>)`` for the docs in ``source``
    (``with_toks=False`` reuses a ``toks`` CTE defined earlier)."""
    head = f"{toks(source)}, " if with_toks else ""
    return f"""{head}{EDGES}, {WEIGHTS},
nodes AS (SELECT *, length(tok_raw) AS len, least(length(tok_raw), 8) AS type FROM toks),
base AS (
  SELECT doc_id, count(*) AS heavy_atoms, CAST(sum(len) AS DOUBLE) AS mol_wt,
         CAST(sum(strlen(tok_raw)) AS DOUBLE) AS exact_mol_wt,
         count_if(regexp_matches(tok_raw, '[0-9]')) AS hbd,
         count_if(substr(tok_raw, 1, 1) <> lower(substr(tok_raw, 1, 1))) AS hba,
         count_if(regexp_matches(tok, '^[aeiou]')) AS vowel,
         CAST(sum(w.log_p) AS DOUBLE) AS log_p, CAST(sum(w.mol_mr) AS DOUBLE) AS mol_mr,
         CAST(sum(w.tpsa) AS DOUBLE) AS tpsa, CAST(sum(w.labute_asa) AS DOUBLE) AS labute_asa
  FROM nodes n JOIN weights w ON n.type = w.type GROUP BY doc_id
),
rot AS (SELECT doc_id, count_if(src_len > 3 AND dst_len > 3) AS rotatable_bonds FROM edges GROUP BY doc_id),
tc AS (SELECT doc_id, tok, count(*) AS c FROM nodes GROUP BY doc_id, tok),
ent AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS class_entropy FROM tc GROUP BY doc_id),
va AS (SELECT doc_id, count(*) AS v FROM tc GROUP BY doc_id),
ea AS (SELECT doc_id, count(*) AS e FROM (
         SELECT DISTINCT doc_id, least(src_tok, dst_tok), greatest(src_tok, dst_tok)
         FROM edges WHERE src_tok <> dst_tok) x GROUP BY doc_id),
sv AS (SELECT DISTINCT doc_id, tok AS x FROM nodes WHERE len <= 4),
sp AS (SELECT DISTINCT doc_id, least(src_tok, dst_tok) AS u, greatest(src_tok, dst_tok) AS v
       FROM edges WHERE src_len <= 4 AND dst_len <= 4 AND src_tok <> dst_tok),
arcs AS (SELECT doc_id, u AS a, v AS b FROM sp UNION ALL SELECT doc_id, v, u FROM sp),
reach(doc_id, x, root) AS (
  SELECT doc_id, x, x FROM sv
  UNION
  SELECT r.doc_id, a.b, r.root FROM reach r JOIN arcs a ON r.doc_id = a.doc_id AND r.x = a.a
),
comp AS (SELECT doc_id, x, min(root) AS root FROM reach GROUP BY doc_id, x),
sr AS (
  SELECT c.doc_id, c.nc - c.nv + coalesce(p.ne, 0) AS aromatic_rings
  FROM (SELECT doc_id, count(DISTINCT root) AS nc, count(*) AS nv FROM comp GROUP BY doc_id) c
  LEFT JOIN (SELECT doc_id, count(*) AS ne FROM sp GROUP BY doc_id) p ON c.doc_id = p.doc_id
),
desc0 AS (
  SELECT b.doc_id, b.mol_wt, b.exact_mol_wt, b.log_p, b.tpsa, b.hbd, b.hba,
         coalesce(r.rotatable_bonds, 0) AS rotatable_bonds,
         coalesce(ea.e, 0) - va.v + 1 AS ring_count,
         coalesce(sr.aromatic_rings, 0) AS aromatic_rings,
         coalesce(ea.e, 0) - va.v + 1 - coalesce(sr.aromatic_rings, 0) AS aliphatic_rings,
         b.heavy_atoms, CASE WHEN b.heavy_atoms > 0 THEN CAST(b.vowel AS DOUBLE) / b.heavy_atoms ELSE 0.0 END
           AS fraction_csp3,
         b.mol_mr, b.labute_asa, e.class_entropy
  FROM base b LEFT JOIN rot r ON b.doc_id = r.doc_id
  LEFT JOIN ent e ON b.doc_id = e.doc_id
  LEFT JOIN va ON b.doc_id = va.doc_id
  LEFT JOIN ea ON b.doc_id = ea.doc_id
  LEFT JOIN sr ON b.doc_id = sr.doc_id
)"""


DESC_INT = ("hbd", "hba", "rotatable_bonds", "ring_count", "aromatic_rings", "aliphatic_rings",
            "heavy_atoms")
DESC_ALL = ("mol_wt", "exact_mol_wt", "log_p", "tpsa", "hbd", "hba", "rotatable_bonds",
            "ring_count", "aromatic_rings", "aliphatic_rings", "heavy_atoms", "fraction_csp3",
            "mol_mr", "labute_asa", "class_entropy")


def desc_select(alias: str = "x", fill: bool = True) -> str:
    out = []
    for c in DESC_ALL:
        v = f"coalesce({alias}.{c}, 0)" if fill else f"{alias}.{c}"
        out.append(f"CAST({v} AS BIGINT) AS {c}" if c in DESC_INT else f"round(CAST({v} AS DOUBLE), 6) AS {c}")
    return ", ".join(out)


ORACLES["descriptors"] = f"""WITH RECURSIVE {descriptor_ctes('documents')}
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, {desc_select()}
FROM documents d LEFT JOIN desc0 x ON d.doc_id = x.doc_id"""

ORACLES["fill_zero"] = f"""WITH RECURSIVE valid_docs AS (SELECT * FROM documents WHERE coalesce({VALID}, false)),
{descriptor_ctes('valid_docs')}
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(l.toxic AS DOUBLE) AS label, {desc_select()}
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN desc0 x ON d.doc_id = x.doc_id"""

ORACLES["combined_features"] = f"""WITH RECURSIVE {FP_TABLE}, {descriptor_ctes('labelled', with_toks=False)}
SELECT f.doc_id, f.label, f.n_on, f.bits AS bits_csv, {desc_select()}
FROM fpt f LEFT JOIN desc0 x ON f.doc_id = x.doc_id"""

ORACLES["alignment_check"] = """
SELECT count(d.doc_id) AS n_left, count(l.doc_id) AS n_right,
       CAST(count_if(d.doc_id IS NULL OR l.doc_id IS NULL) AS BIGINT) AS n_mismatch
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id"""

ORACLES["csv_roundtrip"] = "SELECT * FROM customer"
ORACLES["tsv_roundtrip"] = "SELECT * FROM nation"

# ------------------------------------------------------------------ metrics family

DOC_CUM = SCORED + "," + _cum("model, fold")

ORACLES["confusion"] = f"""WITH {SCORED}
SELECT model, fold, CAST(y_true AS BIGINT) AS actual,
       CAST(count_if(y_prob <= 0.5) AS BIGINT) AS pred_0, CAST(count_if(y_prob > 0.5) AS BIGINT) AS pred_1
FROM scored GROUP BY model, fold, y_true"""

ORACLES["roc_points"] = f"""WITH {DOC_CUM}
SELECT model, fold, round(score, 6) AS threshold,
       round(CASE WHEN N > 0 THEN CAST(cum_neg AS DOUBLE) / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN CAST(cum_pos AS DOUBLE) / P END, 6) AS tpr
FROM cum"""

ORACLES["roc_points_reduced"] = f"""WITH {DOC_CUM},
turns AS (
  SELECT *, (cum_neg - lag(cum_neg) OVER w) * (lead(cum_pos) OVER w - cum_pos)
            - (cum_pos - lag(cum_pos) OVER w) * (lead(cum_neg) OVER w - cum_neg) AS turn
  FROM cum WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC)
)
SELECT model, fold, round(score, 6) AS threshold,
       round(CASE WHEN N > 0 THEN CAST(cum_neg AS DOUBLE) / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN CAST(cum_pos AS DOUBLE) / P END, 6) AS tpr
FROM turns WHERE turn IS NULL OR turn <> 0"""

ORACLES["roc_auc"] = f"""WITH {DOC_CUM},{_rank("model, fold")}
SELECT model, fold, round(roc_auc, 6) AS roc_auc FROM rnk"""

ORACLES["average_precision"] = f"""WITH {DOC_CUM},{_rank("model, fold")}
SELECT model, fold, round(pr_auc, 6) AS pr_auc FROM rnk"""

_MNAMES = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
_CLS_RAW = CLS_COLUMNS.replace("round(", "(").replace(", 6) AS", ") AS")
ORACLES["metric_summary"] = f"""WITH {SCORED},{_cls("model, fold")},{_cum("model, fold")},{_rank("model, fold")},
per_fold AS (
  SELECT c.model, c.fold, {_CLS_RAW}, r.roc_auc, r.pr_auc
  FROM cls c JOIN rnk r ON c.model = r.model AND c.fold = r.fold
)
SELECT model, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in _MNAMES)}
FROM per_fold GROUP BY model"""

# ------------------------------------------------------------------ scaling

def _desc_long(src: str = "desc0") -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS feature, CAST({1024 + j} AS BIGINT) AS feature_idx, "
        f"CAST({c} AS DOUBLE) AS x FROM {src}" for j, c in enumerate(DESC_ALL))


ORACLES["scale_descriptors"] = f"""WITH RECURSIVE {LABELLED}, {descriptor_ctes('labelled')}, {FOLDS},
dl AS (SELECT d.*, f.fold FROM desc0 d JOIN folds f ON d.doc_id = f.doc_id),
lng AS ({_desc_long('dl')}),
lf AS (SELECT l.*, f.fold FROM lng l JOIN folds f ON l.doc_id = f.doc_id),
st AS (SELECT feature, avg(x) AS mu, stddev_pop(x) AS sd FROM lf WHERE fold <> 1 GROUP BY feature),
z AS (SELECT lf.doc_id, lf.fold, lf.feature,
             (lf.x - st.mu) / CASE WHEN st.sd > 0 THEN st.sd ELSE 1.0 END AS z
      FROM lf JOIN st ON lf.feature = st.feature)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(fold AS BIGINT) AS fold,
  {", ".join(f"round(max(CASE WHEN feature = '{c}' THEN z END), 6) AS {c}" for c in DESC_ALL)}
FROM z GROUP BY doc_id, fold"""

# ------------------------------------------------------------------ embedding attributions

EMB = """
el AS (
  SELECT vec_id, label, CAST(u.x AS DOUBLE) AS x, CAST(u.j - 1 AS BIGINT) AS feature_idx
  FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, j)
),
models AS (SELECT * FROM (VALUES ('lt3', 3), ('lt5', 5), ('lt7', 7)) t(model, thr)),
coef AS (
  SELECT m.model, e.feature_idx, avg(e.x) AS mu,
         avg(CASE WHEN e.label < m.thr THEN e.x END) - avg(CASE WHEN NOT (e.label < m.thr) THEN e.x END) AS w
  FROM el e, models m GROUP BY m.model, e.feature_idx
),
phi AS (
  SELECT c.model, e.vec_id, e.feature_idx, e.x AS value, c.w * (e.x - c.mu) AS phi, c.w * e.x AS wx,
         c.w * c.mu AS wmu
  FROM el e JOIN coef c ON e.feature_idx = c.feature_idx
),
mabs AS (SELECT model, feature_idx, avg(abs(phi)) AS mean_abs FROM phi GROUP BY model, feature_idx)"""

ORACLES["linear_attr"] = f"""WITH {EMB},
base AS (SELECT model, sum(wmu) AS baseline FROM (SELECT DISTINCT model, feature_idx, wmu FROM phi) GROUP BY model)
SELECT p.model, p.vec_id, round(max(b.baseline), 6) AS baseline, round(sum(p.wx), 6) AS raw_score,
       round(sum(p.phi), 6) AS phi_sum
FROM phi p JOIN base b ON p.model = b.model GROUP BY p.model, p.vec_id"""

ORACLES["attr_long"] = f"""WITH {EMB}
SELECT model, vec_id, feature_idx, round(phi, 6) AS phi FROM phi"""

ORACLES["mean_abs_attr"] = f"""WITH {EMB}
SELECT model, feature_idx, round(mean_abs, 6) AS mean_abs FROM mabs"""

ORACLES["topn_importance"] = f"""WITH {EMB}
SELECT feature_idx, round(mean_abs, 6) AS mean_abs FROM mabs WHERE model = 'lt5'
ORDER BY mean_abs DESC, feature_idx LIMIT 10"""

ORACLES["summary_points"] = f"""WITH {EMB},
top AS (SELECT feature_idx FROM mabs WHERE model = 'lt5' ORDER BY mean_abs DESC, feature_idx LIMIT 5)
SELECT vec_id, feature_idx, round(phi, 6) AS phi, round(value, 6) AS value
FROM phi WHERE model = 'lt5' AND feature_idx IN (SELECT feature_idx FROM top)"""

# ------------------------------------------------------------------ document importance

DL = """
dl AS (
  SELECT doc_id, 'toxic' AS model, CAST(label AS INTEGER) AS label FROM labelled
  UNION ALL
  SELECT doc_id, 'quality', CAST(quality AS INTEGER) FROM labels_q
)"""

DOC_BASE = f"""{LABELLED.replace('d.n_chars, l.toxic AS label', 'd.n_chars, l.toxic AS label, l.quality')},
labels_q AS (SELECT * FROM labelled WHERE quality IS NOT NULL),
{DL.strip()}"""


def _bit_imp(bits: str = "bits", dl: str = "dl", group: str = "model") -> str:
    gsel = ", ".join(f"p.{g}" for g in group.split(", "))
    gjoin = " AND ".join(f"p.{g} = t.{g}" for g in group.split(", "))
    dsel = ", ".join(f"d.{g}" for g in group.split(", "))
    return f"""
tot_{bits} AS (SELECT {group}, count_if(label = 1) AS N1, count_if(label = 0) AS N0 FROM {dl} GROUP BY {group}),
per_{bits} AS (
  SELECT {dsel}, b.bit, count_if(d.label = 1) AS n1, count_if(d.label = 0) AS n0
  FROM {bits} b JOIN {dl} d ON b.doc_id = d.doc_id GROUP BY {dsel}, b.bit
),
imp_{bits} AS (
  SELECT {gsel}, 'ECFP_' || CAST(p.bit AS VARCHAR) AS feature, CAST(p.bit AS BIGINT) AS feature_idx,
         'ECFP' AS family,
         abs(p.n1 / t.N1 - p.n0 / t.N0) * 2 * ((p.n1 + p.n0) / (t.N1 + t.N0))
           * (1 - (p.n1 + p.n0) / (t.N1 + t.N0)) AS mean_abs
  FROM per_{bits} p JOIN tot_{bits} t ON {gjoin}
)"""


BITS_DOC = f"""{DOC_BASE}, {toks('labelled')}, {envs(3)},
bits AS (SELECT DISTINCT doc_id, bit FROM envs),
{_bit_imp().strip()}"""

DESC_IMP = f"""
dlong AS ({_desc_long('desc0')}),
dst AS (SELECT feature, avg(x) AS mu, stddev_pop(x) AS sd FROM dlong GROUP BY feature),
dz AS (SELECT l.doc_id, l.feature, l.feature_idx,
              (l.x - s.mu) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1.0 END AS z
       FROM dlong l JOIN dst s ON l.feature = s.feature),
dzl AS (SELECT z.*, d.model, d.label FROM dz z JOIN dl d ON z.doc_id = d.doc_id),
dw AS (SELECT model, feature, feature_idx,
              avg(CASE WHEN label = 1 THEN z END) - avg(CASE WHEN label = 0 THEN z END) AS w, avg(z) AS mu
       FROM dzl GROUP BY model, feature, feature_idx),
dmad AS (SELECT d.model, d.feature, d.feature_idx, max(w.w) AS w, avg(abs(d.z - w.mu)) AS mad
         FROM dzl d JOIN dw w ON d.model = w.model AND d.feature = w.feature GROUP BY d.model, d.feature, d.feature_idx),
dimp AS (SELECT model, feature, feature_idx, 'descriptor' AS family, abs(coalesce(w, 0.0)) * mad AS mean_abs FROM dmad),
comb AS (SELECT * FROM imp_bits UNION ALL SELECT * FROM dimp)"""

COMBINED = f"""{BITS_DOC}, {descriptor_ctes('labelled', with_toks=False)}, {DESC_IMP}"""

ORACLES["family_filter"] = f"""WITH RECURSIVE {COMBINED}
SELECT model, feature, round(mean_abs, 6) AS mean_abs FROM comb WHERE starts_with(feature, 'ECFP_')"""

ORACLES["feature_index"] = f"""WITH {BITS_DOC}
SELECT model, feature, CAST(regexp_extract(feature, '_(\\d+)$', 1) AS BIGINT) AS feature_idx
FROM imp_bits WHERE starts_with(feature, 'ECFP_')"""

ORACLES["importance_union"] = f"""WITH RECURSIVE {COMBINED}
SELECT model, feature, family, round(mean_abs, 6) AS mean_abs,
       CAST(row_number() OVER (ORDER BY mean_abs DESC, model, feature) AS BIGINT) AS rank
FROM comb"""

ORACLES["importance_preview"] = f"""WITH RECURSIVE {COMBINED}
SELECT model, feature, round(mean_abs, 6) AS mean_abs FROM comb
ORDER BY mean_abs DESC, model, feature LIMIT 10"""

TOPN = """
topn AS (
  SELECT * FROM (
    SELECT model, feature, feature_idx, mean_abs,
           CAST(row_number() OVER (PARTITION BY model ORDER BY mean_abs DESC, feature_idx) AS BIGINT) AS rank
    FROM imp_bits WHERE starts_with(feature, 'ECFP_')) t
  WHERE rank <= 20
)"""

ORACLES["topn_per_model"] = f"""WITH {BITS_DOC}, {TOPN}
SELECT model, feature, feature_idx, round(mean_abs, 6) AS mean_abs, rank FROM topn"""

ORACLES["mean_of_fold_means"] = f"""WITH {BITS_DOC}, {FOLDS},
dlf AS (SELECT d.*, f.fold FROM dl d JOIN folds f ON d.doc_id = f.doc_id),
{_bit_imp('bits', 'dlf', 'model, fold').replace('tot_bits', 'tot_f').replace('per_bits', 'per_f').replace('imp_bits', 'imp_f').strip()}
SELECT model, feature_idx AS bit, round(avg(mean_abs), 6) AS mean_abs, count(fold) AS n_folds
FROM imp_f GROUP BY model, feature_idx"""

# ------------------------------------------------------------------ fragments

from scorelens.plans.explain import NOTE_FAILED, NOTE_RESOLVED, NOTE_UNRESOLVED  # noqa: E402

FRAG_BASE = f"""{DOC_BASE}, {toks('labelled')}, {envs(3, fragments=True)},
bits AS (SELECT DISTINCT doc_id, bit FROM envs),
{_bit_imp().strip()}, {TOPN}"""


def _frag_rows(top: str) -> str:
    """rows + warn -> frows(model, name, doc_id, bit, fragment, note) for a top table."""
    return f"""
ftop AS (SELECT model, feature_idx AS bit FROM {top}),
firstenv AS (
  SELECT doc_id, bit, radius, pos, fragment FROM (
    SELECT e.doc_id, e.bit, e.radius, e.pos, e.fragment,
           row_number() OVER (PARTITION BY e.doc_id, e.bit ORDER BY e.radius, e.pos) AS rn
    FROM envs e WHERE e.bit IN (SELECT bit FROM ftop)) x
  WHERE rn = 1
),
frows0 AS (
  SELECT t.model, l.source AS name, CAST(f.doc_id AS BIGINT) AS doc_id, CAST(t.bit AS BIGINT) AS bit,
         f.fragment,
         CASE WHEN f.fragment IS NOT NULL THEN '{NOTE_RESOLVED}' ELSE '{NOTE_FAILED}' END AS note
  FROM ftop t JOIN firstenv f ON t.bit = f.bit JOIN labelled l ON l.doc_id = f.doc_id
),
fwarn AS (
  SELECT t.model, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS doc_id, CAST(t.bit AS BIGINT) AS bit,
         CAST(NULL AS VARCHAR) AS fragment, '{NOTE_UNRESOLVED}' AS note
  FROM ftop t
  WHERE NOT EXISTS (SELECT 1 FROM frows0 r WHERE r.model = t.model AND r.bit = t.bit AND r.fragment IS NOT NULL)
),
frows AS (SELECT * FROM frows0 UNION ALL SELECT * FROM fwarn)"""


POOLED_TOP = f"""{FOLDS},
tr AS (SELECT f.doc_id, o.outer_fold FROM folds f, (SELECT range + 1 AS outer_fold FROM range(5)) o
       WHERE f.fold <> o.outer_fold),
dlt AS (SELECT d.doc_id, d.model, d.label, t.outer_fold FROM dl d JOIN tr t ON d.doc_id = t.doc_id),
{_bit_imp('bits', 'dlt', 'model, outer_fold').replace('tot_bits', 'tot_o').replace('per_bits', 'per_o').replace('imp_bits', 'imp_o').strip()},
pooled AS (SELECT model, feature_idx, avg(mean_abs) AS mean_abs FROM imp_o GROUP BY model, feature_idx),
ptop AS (
  SELECT * FROM (
    SELECT model, feature_idx, mean_abs,
           row_number() OVER (PARTITION BY model ORDER BY mean_abs DESC, feature_idx) AS rank
    FROM pooled) x
  WHERE rank <= 20
)"""

ORACLES["bit_fragments"] = f"""WITH {FRAG_BASE}, {_frag_rows("topn")}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(bit AS BIGINT) AS bit, CAST(radius AS BIGINT) AS radius,
       pos, fragment
FROM firstenv"""

ORACLES["top_bit_fragments"] = f"""WITH {FRAG_BASE}, {_frag_rows("topn")}
SELECT * FROM frows"""

ORACLES["top_bit_fragments_pooled"] = f"""WITH {FRAG_BASE}, {POOLED_TOP}, {_frag_rows("ptop")}
SELECT * FROM frows"""

ORACLES["fragments_nonblank"] = f"""WITH {FRAG_BASE}, {_frag_rows("topn")}
SELECT model, doc_id, bit, fragment FROM frows WHERE fragment IS NOT NULL AND trim(fragment) <> ''"""

BENCH_ROWS = f"""{BITS_DOC}, {TOPN},
words AS (
  SELECT CAST(s.item_id AS BIGINT) AS doc_id, CAST(u.pos - 1 AS BIGINT) AS pos, lower(u.t) AS tok
  FROM benchmark s, unnest(regexp_split_to_array(s.text, '[ \\n]+')) WITH ORDINALITY AS u(t, pos) WHERE u.t <> ''
),
wbits AS (SELECT *, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 1024 AS BIGINT) AS bit FROM words),
bfirst AS (SELECT doc_id, bit, arg_min(tok, pos) AS fragment FROM wbits GROUP BY doc_id, bit),
brows AS (
  SELECT t.model, 'item_' || CAST(f.doc_id AS VARCHAR) AS name, f.doc_id, t.feature_idx AS bit, f.fragment,
         '{NOTE_RESOLVED}' AS note
  FROM topn t JOIN bfirst f ON t.feature_idx = f.bit
),
ball AS (
  SELECT * FROM brows UNION ALL
  SELECT t.model, NULL, NULL, t.feature_idx, NULL, '{NOTE_UNRESOLVED}' FROM topn t
  WHERE NOT EXISTS (SELECT 1 FROM brows r WHERE r.model = t.model AND r.bit = t.feature_idx)
)"""

ORACLES["benchmark_fragments"] = f"""WITH {BENCH_ROWS}
SELECT * FROM ball"""

ORACLES["unresolved_bits"] = f"""WITH {BENCH_ROWS}
SELECT model, bit FROM ball GROUP BY model, bit HAVING NOT bool_or(fragment IS NOT NULL)"""

ORACLES["bit_collisions"] = f"""WITH {FRAG_BASE}
SELECT CAST(bit AS BIGINT) AS bit, count(DISTINCT fragment) AS n_fragments
FROM envs WHERE fragment IS NOT NULL GROUP BY bit HAVING count(DISTINCT fragment) > 1"""

ORACLES["first_last_per_key"] = f"""WITH {FRAG_BASE}, {_frag_rows("topn")},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, bit ORDER BY doc_id) AS r_first,
            row_number() OVER (PARTITION BY model, bit ORDER BY doc_id DESC) AS r_last
  FROM frows WHERE doc_id IS NOT NULL
)
SELECT model, bit, min(doc_id) AS first_doc, max(CASE WHEN r_first = 1 THEN fragment END) AS first_fragment,
       max(doc_id) AS last_doc, max(CASE WHEN r_last = 1 THEN fragment END) AS last_fragment
FROM ranked GROUP BY model, bit"""

LOOKUP = f"""{FRAG_BASE}, {_frag_rows("topn")},
dict0 AS (
  SELECT model, bit, fragment, row_number() OVER (
           PARTITION BY model, bit ORDER BY CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END DESC,
                                     coalesce(doc_id, -1) DESC) AS rn
  FROM frows
),
dict AS (SELECT model, bit, fragment FROM dict0 WHERE rn = 1),
lookup AS (
  SELECT t.model, t.feature, CAST(t.feature_idx AS BIGINT) AS bit, t.mean_abs,
         CASE WHEN d.bit IS NULL THEN 'N/A' ELSE d.fragment END AS fragment
  FROM topn t LEFT JOIN dict d ON t.model = d.model AND t.feature_idx = d.bit
)"""

ORACLES["fragment_lookup"] = f"""WITH {LOOKUP}
SELECT model, bit, feature, fragment, round(mean_abs, 6) AS mean_abs FROM lookup"""

ORACLES["importance_merge"] = f"""WITH {LOOKUP}
SELECT feature, fragment,
       round(max(CASE WHEN model = 'toxic' THEN mean_abs END), 6) AS mean_abs_toxic,
       round(max(CASE WHEN model = 'quality' THEN mean_abs END), 6) AS mean_abs_quality
FROM lookup GROUP BY feature, fragment"""

from scorelens.plans import fitted_oracles  # noqa: E402

ORACLES.update(fitted_oracles.ORACLES)
