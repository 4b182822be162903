"""Belief steps against plain NumPy."""

import numpy as np

from rulefact.operators import beliefs as B

NODES = "case_id long, node_type string, node_id long, logits array<double>, frozen boolean"


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def test_gated_steps_equal_a_plain_loop(spark):
    """Five steps with an exception gate: the exception of an entity damps what its fact is sent; feedback moves the exception too."""
    nodes = {(1, "c_x", 7): [2.0, -1.0], (1, "fact", 70): [0.3, 0.0, -0.2], (2, "c_x", 8): [-1.0, 1.0], (2, "fact", 80): [0.0, 0.1, 0.0], (2, "c_y", 8): [0.5, 0.0]}
    edges = [(1, "c_x", 7, "says", "fact", 70), (2, "c_x", 8, "says", "fact", 80), (2, "c_y", 8, "also", "fact", 80), (2, "fact", 80, "back", "c_x", 8), (1, "fact", 70, "role_of", "c_x", 7)]
    weights = {("c_x", "says", "fact"): np.array([[0.7, 0.0, 0.1], [0.0, 0.4, 0.0]]), ("c_y", "also", "fact"): np.array([[0.2, 0.2, 0.0], [0.0, 0.0, 0.3]]), ("fact", "back", "c_x"): np.array([[0.5, 0.0], [0.0, 0.6], [0.1, 0.1]])}
    gates = {("c_x", "fact"): np.array([1.2, -0.4])}
    frozen = {(1, "c_x", 7)}

    want = {k: np.array(v) for k, v in nodes.items()}
    for _ in range(5):
        moved = {}
        for case, st, si, relation, dt, di in edges:
            if (st, relation, dt) in weights:
                moved[case, dt, di] = moved.get((case, dt, di), 0) + softmax(want[case, st, si]) @ weights[st, relation, dt]
        score = {(case, i): 1 / (1 + np.exp(-(softmax(l) @ gates["c_x", "fact"]))) for (case, kind, i), l in want.items() if kind == "c_x"}
        gate = {(1, "fact", 70): 1 - score[1, 7], (2, "fact", 80): 1 - score[2, 8]}  # by role edge; by the only one of the case
        want = {k: v if k in frozen else v + moved.get(k, 0) * gate.get(k, 1.0) for k, v in want.items()}

    n = spark.createDataFrame([(*k, v, k in frozen) for k, v in nodes.items()], NODES)
    e = spark.createDataFrame(edges, "case_id long, src_type string, src_id long, relation string, dst_type string, dst_id long")
    w = spark.createDataFrame([(*k, i, j, float(m[i, j]), None) for k, m in weights.items() for i in range(m.shape[0]) for j in range(m.shape[1])], "src_type string, relation string, dst_type string, i int, j int, w_pos double, w_neg_raw double")
    g = spark.createDataFrame([(*k, i, float(u)) for k, v in gates.items() for i, u in enumerate(v)], "exc_type string, dst_type string, i int, u double")
    got = {(r.case_id, r.node_type, r.node_id): r.logits for r in B.propagate(n, e, w, steps=5, gate_weights=g)[0].collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-9), (k, got[k], v)
