import pytest

from parley.functions.templates import CHATML, PLAIN
from parley.operators.prompts import format_chats, user_stats
from tests.support import dialogue_store

LINES = [(1, "system", "s"), (1, "user", "q"), (2, "user", "q"), (2, "assistant", "a")]
RENDERED = {
    CHATML: {
        1: "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n",
        2: "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n",
    },
    PLAIN: {1: "system: s\nuser: q\nassistant: ", 2: "user: q\nassistant: a\n"},
}


@pytest.mark.parametrize("template", [CHATML, PLAIN])
@pytest.mark.parametrize("per_part", [1, 65_536])
def test_prompts(spark, template, per_part):
    _, messages = dialogue_store(spark, LINES)
    found = format_chats(messages, template, per_part).collect()
    assert {row.user_id: row.prompt for row in found} == RENDERED[template] and len(found) == 2


@pytest.mark.parametrize("template", [CHATML, PLAIN])
def test_stats_measure_the_prompt(spark, template):
    _, messages = dialogue_store(spark, LINES)
    stats = {row.user_id: row for row in user_stats(messages, template, 100).collect()}
    for user, prompt in RENDERED[template].items():
        assert stats[user].messages == 2
        assert stats[user].prompt_chars == len(prompt)
        assert stats[user].context_percent == stats[user].prompt_tokens / 100 * 100
    assert user_stats(messages.filter("false"), template).isEmpty()
