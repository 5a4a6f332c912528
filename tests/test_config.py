import json

import pytest

from docketry import config
from docketry.__main__ import main, parser
from docketry.sources import tables

yaml = pytest.importorskip("yaml")


def test_budget_and_corpus(tmp_path):
    b = tmp_path / "budget.yaml"
    b.write_text("prices:\n  m: {input: 0.5, output: 2.5}\ncaps:\n  dev: {usd: 40}\ntotal_stop_usd: 200\n")
    got = config.budget(b)
    assert got.caps == {"dev": 40.0} and got.prices["m"]["output"] == 2.5 and got.total_stop_usd == 200.0
    b.write_text("prices:\n  m: {input: 0.5}\ncaps: {}\ntotal_stop_usd: 1\n")
    with pytest.raises(ValueError, match="input and output"):
        config.budget(b)
    c = tmp_path / "docs.yaml"
    c.write_text("corpus: docs\nformat: tgz\nfiles: []\nchosen_topics: [401, '402']\n")
    assert config.corpus(c).chosen_topics == ("401", "402")
    c.rename(tmp_path / "other.yaml")
    with pytest.raises(ValueError, match="docs"):
        config.corpus(tmp_path / "other.yaml")
    (tmp_path / "list.yaml").write_text("- a\n")
    with pytest.raises(ValueError, match="mapping"):
        config.load(tmp_path / "list.yaml")


def test_pipeline_and_all_faults_at_once(tmp_path):
    p = tmp_path / "pipeline.yaml"
    p.write_text("paths: {store: s}\nmodels: {a: b}\nbatch: {}\nseeds: {devset: 42}\nsampling: {}\nnormalization: {version: 1}\n")
    got = config.pipeline(p)
    assert got.normalization_version == "1" and got.preprocess == {} and got.seeds == {"devset": 42}
    p.write_text("paths: x\nmodels: {}\nbatch: {}\nsampling: {}\nnormalization: 3\n")
    with pytest.raises(ValueError, match="paths is of type str; seeds is missing; normalization.version is missing"):
        config.pipeline(p)
    c = tmp_path / "docs.yaml"
    c.write_text("corpus: docs\nformat: zip\nfiles: [{name: a}]\ncustodians: [{name: x}]\nexpected_message_count: 3\n")
    assert config.corpus(c) == config.Corpus("docs", "zip", ({"name": "a"},), (), ({"name": "x"},), 3)


def test_commands(spark, tmp_path, capsys):
    assert parser().parse_args(["preprocess", "r", "c", "p"]).command == "preprocess"
    runs = tmp_path / "runs.jsonl"
    assert main(["--runs", str(runs), "query", "nothing", "x"]) == 2
    assert main(["--runs", str(runs), "status", str(tmp_path), "docs"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1] == "}" and "{}") == {}
    assert main(["preprocess", str(tmp_path), "docs", str(tmp_path / "r.json")]) == 2
    got = [json.loads(x) for x in runs.read_text().splitlines()]
    assert [(r["command"], r["exit_code"]) for r in got] == [("query", 2), ("status", 0)]
    assert tables.text_of(" a\n b ") == "a b"
