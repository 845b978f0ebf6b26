from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def vocab():
    """Where the public vocabulary files lie, or a skip where they are missing."""
    return pytest.importorskip("public_tokenizers").path
