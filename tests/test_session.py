"""Where intermediate tables may lie."""

import pytest

from adtally import session


class Settings:
    def __init__(self, **settings):
        self.settings, self.conf = settings, self

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_only_a_local_session_has_a_folder_of_its_own():
    warehouse = {"spark.sql.warehouse.dir": "/w"}
    assert session.shared_folder(Settings(**warehouse, **{"spark.master": "local"})) == "/w/adtally-staging"
    assert session.shared_folder(Settings(**warehouse, **{"spark.master": "yarn", "spark.checkpoint.dir": "/shared/"})) == "/shared"
    for master in ("yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            session.shared_folder(Settings(**warehouse, **{"spark.master": master}))
