import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("leadloom-tests", "local[8]", spark__sql__shuffle__partitions=4,
                            spark__ui__enabled="false", spark__driver__memory="8g",
                            spark__ui__showConsoleProgress="false", spark__default__parallelism=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *names):
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((v is None, v) for v in t))
