"""Every linked document goes through the rounds of label propagation."""

from contrasieve.llm import sharding


def test_groups_that_fit_are_placed_by_propagation(spark, monkeypatch):
    docs = [(i, f"text {i % 30} " * (1 + i % 30)) for i in range(240)] + [(1000 + i, f"lone {i} " * 20) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rounds = []
    real = sharding.propagate

    def propagate(linked, *args, **options):
        out = real(linked, *args, **options)
        rounds.append((linked.count(), {r["hub"]: r["n"] for r in out.groupBy("hub").agg({"shard": "count"}).withColumnRenamed("count(shard)", "n").collect()}, out.select("hub", "shard").distinct().count()))
        return out

    monkeypatch.setattr(sharding, "propagate", propagate)
    got = sharding.shard(df, shards=4).collect()
    assert rounds and rounds[0][0] == 240 and set(rounds[0][1].values()) == {8}
    assert rounds[0][2] == 30  # there is room, so the rounds alone bring every group together
    texts = dict(docs)
    where, load = {}, [0] * 4
    for r in got:
        load[r["shard"]] += r["size"]
        if r["doc_id"] < 1000:
            where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(got) == len(docs) and all(len(s) == 1 for s in where.values())
    assert max(load) - min(load) <= 2 * max(r["size"] for r in got)
