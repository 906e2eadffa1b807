import io
import json
import tarfile

import pytest
from vecloom import __main__ as cli
from vecloom import config
from vecloom.plans import catalog
from vecloom.sources import files

TOML = """
seed = 7
[image_dataset]
name = "cifar10"
[method]
name = "kmeans"
[method.params]
redo = 2
iterations = 20
"""


def test_overrides():
    got = config.overrides(["dataset=stl10", "attack.eps=0.1", "method.redo=3", "metrics=nmi, ari", "dataset.max_samples=none", "method.name=tac", "adversarial=false"])
    assert got == {
        "image_dataset": {"name": "stl10", "attack": {"eps": 0.1, "enabled": False}, "max_samples": None},
        "method": {"params": {"redo": 3}, "name": "tac"},
        "evaluation": {"metrics": ["nmi", "ari"]},
    }
    assert [config.parse_value(v) for v in ("[a, 'b']", "[]", "[1, 2]", "x", "NULL", "1.5", '"a,b"')] == [["a", "b"], [], [1, 2], "x", None, 1.5, "a,b"]
    for bad in ("nokey", "=1", "strange=1"):
        with pytest.raises(ValueError):
            config.overrides([bad])
    with pytest.raises(TypeError):
        config.overrides(["seed=1", "seed.x=2"])


def test_merge():
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}}


def test_experiment_and_fingerprint():
    e = config.experiment(TOML)
    assert (e.seed, e.metrics, e.output_dir) == (7, ("nmi", "ari", "acc"), "outputs/kmeans/cifar10/laion400m_vit-b-32/seed_7")
    assert config.trial(e) == config.trial(config.experiment(TOML)) != config.trial(config.experiment(TOML, ["seed=8"]))
    assert config.trial(e) == config.trial(config.experiment(TOML, ["metrics=nmi"]))  # evaluation doesn't change predictions
    assert "attack-shift-anyattack-cos-coco-cos-eps8-255-seed7" in config.experiment(TOML, ["attack=shift"]).output_dir
    assert config.experiment(TOML, ["output_dir=here"]).output_dir == "here"
    assert config.seeded({"seed": 1}, 9) == {"seed": 1, "random_state": 9}
    for bad in (float("nan"), {1, 2}):
        with pytest.raises((ValueError, TypeError)):
            config.encoded(bad)
    assert config.trial(e) != config.trial(config.experiment(TOML, ["text_dataset.name=wordnet"])) != config.trial(config.experiment(TOML, ["image_features.model=x"]))
    value = {"b": [1, 2.5, None, True, "\u00e9"], "a": {"z": (1,), "y": {}}}
    assert config.encoded(value) == json.dumps(value, sort_keys=True, separators=(",", ":"))
    with pytest.raises(TypeError):
        config.experiment(TOML, ["internal_metrics_only=1"])
    with pytest.raises(ValueError):
        config.experiment("seed = 1")


def test_profiles():
    profiles = {("laion2b", "vitb16", "cifar10"): {"gamma": 3, "k": 1}}
    assert config.resolved(profiles, "LAION-2B", "ViT-B/16", "CIFAR_10", {"k": 5, "z": None}) == {"gamma": 3, "k": 5}
    assert config.resolved(profiles, "SigLIP", "ViT-B/16", "cifar10", {"k": 5}) == {"k": 5}


def test_steps():
    plan = config.steps(config.experiment(TOML))
    assert plan[0].startswith("prepare image dataset") and plan[-1] == "evaluate with metrics: nmi, ari, acc"
    for item in ("dataset=nosuch", "method=nosuch", "metrics=[f1]"):
        with pytest.raises(ValueError):
            config.steps(config.experiment(TOML, [item]))
    assert config.keeps_checkpoints("ImageNet") and not config.keeps_checkpoints("imagenet10")


def test_catalogue():
    assert catalog.dataset("ImageNet-Dogs").name == "imagenet_dogs" and len(catalog.DATASETS) == 20
    assert catalog.evaluation_split("imagenet_r") == "test" and catalog.default_split("DTD") == ("trainval", "test")
    assert catalog.encoder("laion-2b", "vit_b_16") == ("ViT-B-16", "laion2b_s34b_b88k")
    assert catalog.domain_shift("imagenet", "imagenet_a") == ("imagenet", "train", "imagenet_a", "test", True)
    for bad in (lambda: catalog.dataset("x"), lambda: catalog.encoder("SigLIP", "ViT-L/14"), lambda: catalog.domain_shift("cifar10", "imagenet_a"), lambda: catalog.default_split("imagenet_a")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        files.checked_split("test", ("train",))


def test_image_folder_and_subset(spark, tmp_path):
    for cls, n in (("cat", 2), ("ant", 1), ("dog", 3)):
        (tmp_path / "train" / cls).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "train" / cls / f"{i}.png").write_bytes(bytes([i]))
    (tmp_path / "train" / "cat" / "notes.txt").write_text("x")
    rows = files.image_folder(spark, str(tmp_path), "train")
    got = {(r.id, r.class_name, r.label) for r in rows.collect()}
    assert got == {(0, "ant", 0), (1, "cat", 1), (2, "cat", 1), (3, "dog", 2), (4, "dog", 2), (5, "dog", 2)}
    (tmp_path / "list.txt").write_text("# head\ndog  # good\n\ncat\n")
    wanted = files.class_list(spark, str(tmp_path / "list.txt"))
    assert files.class_subset(rows, wanted).count() == 5
    with pytest.raises(ValueError, match="fox"):
        files.class_subset(rows, spark.createDataFrame([("fox",)], "class_name string"))
    numbered = rows.selectExpr("id", "cast(label as string) as class_name")
    names = spark.createDataFrame([("b",), ("a",), ("c",)], "class_name string")
    assert {(r.id, r.class_name) for r in files.renamed_classes(numbered, names).collect()} == {(0, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "c"), (5, "c")}


def test_archives(spark, tmp_path):
    for name, member in (("good.tar", "a/b.txt"), ("bad.tar", "../b.txt")):
        with tarfile.open(tmp_path / name, "w") as tar:
            info = tarfile.TarInfo(member)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
    assert [(r.name, bytes(r.content)) for r in files.tar_members(spark, str(tmp_path / "good.tar")).collect()] == [("a/b.txt", b"hi")]
    with pytest.raises(Exception, match="leaves the archive"):
        files.tar_members(spark, str(tmp_path / "bad.tar")).collect()


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.csv").write_text('word,definition\n dog ,"a, b"\n,blank\ncat,x\ndog,again\n')
    assert [(r.ordinal, r.word) for r in files.vocabulary(spark, str(tmp_path / "v.csv")).orderBy("ordinal").collect()] == [(0, "dog"), (1, "cat"), (2, "dog")]
    (tmp_path / "w.csv").write_text("term\nx\n")
    with pytest.raises(ValueError):
        files.vocabulary(spark, str(tmp_path / "w.csv"))


def test_kept_features_need_the_same_rows_and_parameters(spark, table, tmp_path):
    rows, key = table([[1, 0], [0, 1]]), {"dataset": "d", "max_samples": 2}
    assert files.read_features(spark, str(tmp_path), key, rows) is None
    files.write_features(rows, str(tmp_path), key)
    assert files.read_features(spark, str(tmp_path), key, rows).count() == 2
    assert files.read_features(spark, str(tmp_path), key, table([[1, 0]])) is None
    assert files.read_features(spark, str(tmp_path), key | {"max_samples": 3}, rows) is None


def test_prediction_hash(spark):
    a = spark.createDataFrame([(1, "m", 0), (2, "m", 1)], "id long, head string, cluster int")
    h = lambda d: [tuple(r) for r in files.content_hash(d).collect()]
    assert h(a) == h(a.orderBy("id", ascending=False)) != h(a.selectExpr("id", "head", "1 - cluster as cluster"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "e.toml").write_text(TOML)
    assert cli.main(["run", "--config", str(tmp_path / "e.toml"), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["steps"][-1].startswith("evaluate")
    rows = [(i, [float(i % 2), float(1 - i % 2), 0.01 * i], i % 2) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    report = cli.run(str(tmp_path / "e.toml"), [f"output_dir={tmp_path}/out"], str(tmp_path), False)
    assert report["metrics"] == pytest.approx({"nmi": 1, "ari": 1, "acc": 1})
    assert cli.main(["list-methods"]) == 0 and "kmeans" in capsys.readouterr().out


def test_dataset_stats_by_split(spark, tmp_path, capsys):
    for name in ("cat/a.png", "cat/b.png", "dog/c.png"):
        path = tmp_path / "cifar10" / "train" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    assert cli.main(["dataset-stats", "cifar10", "--data", str(tmp_path)]) == 0
    found = {line["split"]: line for line in map(json.loads, capsys.readouterr().out.splitlines())}
    assert set(found) == set(catalog.dataset("cifar10").splits)
    assert found["train"] == {"split": "train", "n_samples": 3, "n_classes": 2}
    assert all("error" in line for split, line in found.items() if split != "train")
    with pytest.raises(ValueError):
        cli.main(["dataset-stats", "cifar10", "--split", "none", "--data", str(tmp_path)])


def test_values_of_overrides():
    got = {"{a = 1, b = [x, 2]}": {"a": 1, "b": ["x", 2]}, "[[1, 2], [3]]": [[1, 2], [3]], "true": True, "1_000": 1000, "007": "007", "-3e4": -3e4, "nmi,": ["nmi"], "it's": "it's", "": "", "0.5,none": [0.5, None], "'a,b',c": ["a,b", "c"]}
    assert {v: config.parse_value(v) for v in got} == got


def test_attacks():
    attack = config.experiment(TOML, ["attack=shift", "attack.apply_to_splits='test,val'", "attack.variant=cos", "attack.decoder_path=a/b.pt", "attack.target_strategy=random"]).image_dataset.attack
    assert attack.apply_to_splits == ("test", "val") and attack.enabled and attack.seed == 7
    assert attack.params == {"variant": "cos", "decoder_path": "a/b.pt", "target_strategy": "random"}
    for name in ("none", "false", "None"):
        off = config.experiment(TOML, [f"attack={name}"])
        assert off.image_dataset.attack is None and "attack" not in off.output_dir
    assert config.experiment(TOML, ["attack=shift", "attack.apply_to_splits=[test]"]).image_dataset.attack.apply_to_splits == ("test",)
    assert "attack" not in config.experiment(TOML, ["attack=shift", "adversarial=false"]).output_dir
