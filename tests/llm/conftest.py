import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vocabulary():
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    return path if os.path.exists(path) else None
