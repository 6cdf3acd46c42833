from cinefold import session as library
from cinefold.session import session, settings_kept


def test_a_job_leaves_the_callers_settings(spark, monkeypatch):
    # A setting of the application that the caller's session was started without.
    monkeypatch.setitem(library.DEFAULTS, "spark.locality.wait", "1s")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with settings_kept(spark):
        assert session({"spark.sql.session.timeZone": "CET", "spark.sql.adaptive.enabled": "false"}) is spark
        assert spark.conf.get("spark.sql.session.timeZone") == "CET"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
