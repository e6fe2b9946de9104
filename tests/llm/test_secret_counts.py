"""The contract columns of op4_secret_scan against a plain version, on several spans of one kind a text."""

import hashlib
import re

from inkmeter.llm import secret_scan

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    listed = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return *(sum(k == kind for _, k, _ in found) for kind in range(3)), hashlib.sha256(listed.encode()).hexdigest()


def test_counts_per_kind(spark, tmp_path):
    access, hexes = "AKIAABCDEFGHIJKL", "deadbeef" * 4
    texts = [None, "", "é" + access, hexes, f"{access} {access} {hexes}", f"{hexes}-{hexes} token=abcdefgh1", f"secret:aaaaaaaaa {access} token='hunter22222 {hexes} api_key=short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.query(spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
