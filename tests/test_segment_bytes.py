from quarrylight.operators import segments
from test_segments import corpus, frame


def test_chunks_are_not_stored_twice(spark, tmp_path, monkeypatch):
    stored = {}
    keep = segments.write_shared
    monkeypatch.setattr(segments, "write_shared", lambda df, name: stored.setdefault(name, df.columns) and keep(df, name))
    index = segments.add(segments.load(spark, str(tmp_path)), frame(spark, corpus(3, range(40))))
    index = segments.merge(segments.remove(index, index.chunks().filter("chunk_id % 4 = 1").select("chunk_id")))
    assert stored == {"removed-chunks": ["chunk_id", "seq"]}
    assert index.n == 30 and {r.chunk_id for r in index.chunks().collect()} == {k for k in range(40) if k % 4 != 1}
