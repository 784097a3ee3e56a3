from dataclasses import replace

from quillmark.plans.config import fingerprint, ladder


def test_fingerprints_are_pinned():
    assert [fingerprint(c) for c in ladder()] == [
        "a61b52ce27", "73489207b5", "4130bd632e", "2f4cb2653e", "513df9cff4", "1c3589d9fa", "53260558c5", "47f1b2ce91",
        "a226d89233", "62c8b5d3b0"]


def test_label_is_no_part_of_the_identity():
    a = ladder()[0]
    assert fingerprint(replace(a, label="other")) == fingerprint(a)
    assert fingerprint(replace(a, top_k_context=7)) != fingerprint(a)


def test_rungs_add_one_safeguard_each():
    from dataclasses import asdict

    rungs = ladder()
    changes = [
        {k for k in asdict(a) if k not in ("id", "label") and asdict(a)[k] != asdict(b)[k]} for a, b in zip(rungs, rungs[1:], strict=False)]
    assert [len(c) for c in changes] == [1, 1, 1, 1, 1, 2, 1, 1, 1]
