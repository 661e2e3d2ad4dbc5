"""Parameters of the command line reach the plans."""

from strandline import cli
from strandline.plans import settings


def test_freeze_moves_results(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *a: spark)
    for name in ("FREEZE", "CUTOFF", "CUTOFFS", "HORIZON", "SELF_CUTOFF"):
        monkeypatch.setattr(settings, name, getattr(settings, name))  # put back afterwards
    got = {}
    for query, flag in (("survival_by_support", ["--freeze", "1998"]), ("recent_previous_trend", ["--cutoff", "1996"])):
        for i, flags in enumerate(([], flag)):
            assert cli.main([query, "--data", sf_dir, "--out", f"file://{tmp_path}/{query}{i}", *flags]) == 0
            got[query, i] = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/{query}{i}").collect()), key=str)
        assert got[query, 0] != got[query, 1]
    assert settings.FREEZE == 1998 and settings.CUTOFF == 1996
    assert cli.parser().parse_args(["x", "--data", "d", "--cutoffs", "1999,1997"]).cutoffs == (1997, 1999)
