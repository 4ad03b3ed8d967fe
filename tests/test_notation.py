"""F1 molecule producer on the literal fixtures (FIXTURES.md D: entities_tiny)."""

import pytest

from scorelens.operators.notation import notation_graph

# Fixture strings and their expected (atoms, bonds) counts.
CASES = {
    1: ("CCO", 3, 2),                       # ethanol
    2: ("c1ccccc1", 6, 6),                  # benzene
    3: ("CC(=O)Oc1ccccc1C(=O)O", 13, 13),   # aspirin
    4: ("CC(=O)O", 4, 3),                   # acetic acid
    5: ("[Na+].[Cl-]", 2, 0),               # two-part salt
    6: ("c1ccc2ccccc2c1", 10, 11),          # naphthalene
    7: ("CC(C)(C)C", 5, 4),                 # sibling branches
    8: ("C(C(C)C)C", 5, 4),                 # nested branch
}
INVALID = {9: "C1CC(", 10: "", 11: None, 12: "C1CC", 13: "CC)C(", 14: "C?C"}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(k, s) for k, (s, _, _) in CASES.items()] + list(INVALID.items())
    df = spark.createDataFrame(rows, "entity_id long, smiles string")
    nodes, edges, validity = notation_graph(df)
    return ({r["entity_id"]: r["is_valid"] for r in validity.collect()},
            nodes.groupBy("entity_id").count().collect(), edges.collect())


def test_validity(graph):
    valid, _, _ = graph
    for k in CASES:
        assert valid[k], CASES[k][0]
    for k in INVALID:
        assert not valid[k], INVALID[k]


def test_atom_and_bond_counts(graph):
    _, ncounts, edges = graph
    n = {r["entity_id"]: r["count"] for r in ncounts}
    for k, (s, atoms, bonds) in CASES.items():
        assert n.get(k, 0) == atoms, s
        assert sum(1 for e in edges if e["entity_id"] == k) == bonds, s


def test_branch_parents_and_bond_kinds(graph):
    _, _, edges = graph
    sib = sorted((e["src"], e["dst"]) for e in edges if e["entity_id"] == 7)
    assert sib == [(0, 1), (1, 3), (1, 6), (1, 8)]  # all three branches hang off atom 1
    acetic = {(e["src"], e["dst"]): e["kind"] for e in edges if e["entity_id"] == 4}
    assert acetic == {(0, 1): "single", (1, 4): "double", (1, 6): "single"}
    benz = {e["kind"] for e in edges if e["entity_id"] == 2}
    assert benz == {"aromatic"}
