import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobweave.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "jobweave-tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


JOB_COLUMNS = {
    "id": "bigint", "job_title": "string", "organisation_name": "string", "location": "string",
    "org_location": "string", "remote_type": "string", "experience_level": "string", "job_source": "string",
    "job_link": "string", "salary": "string", "dateposted": "string", "added_at": "string",
    "job_description": "string", "views_count": "int", "job_category_id": "int", "is_active": "int",
    "exists_in_uk": "int", "exists_in_london": "int", "has_description": "int", "company_url": "string",
}
DEFAULTS = {"is_active": 1, "exists_in_uk": 0, "exists_in_london": 0, "has_description": 0, "job_link": "https://a.b/c"}


@pytest.fixture(scope="session")
def make_jobs(spark):
    def make(*rows):
        schema = ", ".join(f"{n} {t}" for n, t in JOB_COLUMNS.items())
        full = [[{**DEFAULTS, "id": i, **row}.get(c) for c in JOB_COLUMNS] for i, row in enumerate(rows, 1)]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def values():
    """Rows of a frame as a sorted list of tuples."""

    def read(frame, *columns):
        return sorted((tuple(r) for r in frame.select(*(columns or frame.columns)).collect()), key=repr)

    return read
