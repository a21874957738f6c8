import pytest

from lexmill import config
from lexmill.operators import corpus
from lexmill.session import read_table, ship


def test_presets_merge_and_checks(tmp_path):
    c = config.build({"samples": {"stride": 64}}, "small")
    assert (c.samples.block, c.samples.stride, c.cleaning.min_line) == (256, 64, 10)
    config.save(c, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == c
    for bad in ({"x": {}}, {"dedup": {"similarity": 2}}, {"samples": {"ratios": [0.5, 0.5, 0.5]}}, {"cleaning": {"nope": 1}}):
        with pytest.raises(config.ConfigError):
            config.build(bad)
    with pytest.raises(config.ConfigError):
        config.build(preset="none")


def test_corpus_to_samples(spark, sf):
    import public_tokenizers

    ship(spark)
    docs = read_table(spark, sf, "documents").limit(40)
    got = corpus.samples(docs, public_tokenizers.path("byte_bpe_50k.json"), config.build({"samples": {"block": 64, "stride": 32}})).collect()
    assert len(got) > 100 and {r.split for r in got} == {"train", "val", "test"}
    assert all(r.input_ids[1:] == r.labels[:-1] and len(r.input_ids) == len(r.labels) for r in got)


def test_summary():
    s = config.summary(config.build({"cleaning": {"emails": False}}, "small"))
    assert s["masks"] == ["urls", "phones"] and s["samples"] == "256 tokens every 128" and s["overlap"] == 0.5 and s["split"]["val"] == 0.1
