import os

import pytest

TOKENIZER = os.environ.get("ZONELEX_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@pytest.fixture
def tokenizer():
    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer file here")
    return TOKENIZER
