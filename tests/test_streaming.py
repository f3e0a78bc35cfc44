"""Files that arrive later are compared with those that came before."""

import pytest

from siltstone.operators import chunker
from siltstone.sources.samples import SampleError, SampleRegistry
from siltstone.streaming import ingest



def test_watch(spark, tmp_path):
    folder, paths = tmp_path / "in", [str(tmp_path / n) for n in ("index", "findings", "checkpoint")]
    folder.mkdir()
    (tmp_path / "index").mkdir()
    (folder / "a.txt").write_text("A note about the annual leave policy of the company.")
    ingest.watch(spark, str(folder), *paths, config=chunker.ChunkConfig()).awaitTermination()
    (folder / "b.txt").write_text("A note about the annual leave policy of the company.")
    (folder / "c.pdf").write_bytes(b"broken")
    ingest.watch(spark, str(folder), *paths, config=chunker.ChunkConfig()).awaitTermination()
    found = spark.read.parquet(paths[1]).collect()
    assert [(r.scope, round(r.score, 6)) for r in found] == [("new_vs_existing", 1.0)]
    assert spark.read.parquet(paths[0]).count() == 2


def test_samples(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"filename": "a.md", "title": "A", "text": "x"}]')
    (tmp_path / "bad.json").write_text('[{"filename": "a.md", "title": " ", "text": "x"}]')
    r = SampleRegistry({"s": str(tmp_path / "s.json"), "bad": str(tmp_path / "bad.json")})
    d = r.load(spark, "s").first()
    assert d.embedded["title"].v == "A" and d.source_path == "s/a.md" and r.load(spark, "s") is r.load(spark, "s")
    for name in ("bad", "none"):
        with pytest.raises(SampleError):
            r.load(spark, name)
    r.clear()
