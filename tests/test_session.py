import os

from pressloom import session


def test_cuts_lie_in_the_shared_folder_and_can_be_removed(spark):
    df = session.cut(spark.range(5).toDF("x"), "t")
    path = df._pressloom_path
    assert path.startswith(session.shared_dir(spark)) and df.count() == 5
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    session.drop_cut(df)
    assert not os.path.exists(local)
    session.cut(spark.range(2).toDF("x"), "t")
    assert session.clear_scratch(spark) >= 1 and session.clear_scratch(spark) == 0


def test_fresh_names():
    assert session.fresh(["a", "_T"], "t") == "t" and session.fresh(["T", "_t"], "t") == "__t"
