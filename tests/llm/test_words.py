import re
import unicodedata

import numpy as np
import pyarrow as pa

from precis.llm import words as wd


def plain(text):
    """Words character by character."""
    out, now = [], ""
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        solo = any(a <= ord(c) <= b for a, b in wd.UNSPACED) and ord(c) > 127
        if kind not in "LMN" or (ord(c) < 128 and not re.match("[a-z0-9]", c)):
            out.append(now)
            now = ""
        elif solo:
            out += [now, c]
            now = ""
        else:
            now += c
    return [w for w in [*out, now] if w]


TEXTS = ["caf\u00e9 au lait", "\u201cquoted\u201d words\u2014dash", "\u6700\u5927\u7684ab\u884c\u661f, x", "\u0e40\u0e21\u0e37\u0e2d\u0e07 thai", "a\u3001b\u3002c",
         "\ud55c\uad6d\uc5b4 \ub2e8\uc5b4", "\U00020000\U00020001x\U0001f600y", "\u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442", "", "e\u0301t\u00e9",
         "plain ascii 12", "\u4e00", "\u20ac5 \u00b0c", "\u3042\u30a2\u4e9c"]


def test_words_of_every_script():
    got = wd.lower_words(pa.array(TEXTS))
    data, _ = wd.buffer(pa.array([t.lower() for t in TEXTS]))
    for k, text in enumerate(TEXTS):
        a, b = got.bounds[k], got.bounds[k + 1]
        assert [data[s:e].tobytes().decode() for s, e in zip(got.starts[a:b], got.ends[a:b])] == plain(text), text


def test_hash_depends_on_the_word_alone():
    a, b = wd.lower_words(pa.array(["x \u6700\u5927"])), wd.lower_words(pa.array(["\u5927, \u6700 X"]))
    assert np.array_equal(np.sort(a.hashes), np.sort(b.hashes)) and len(a.hashes) == 3
