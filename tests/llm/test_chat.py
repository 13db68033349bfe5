from precis.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, speaker string, chunk int"


def brute(rows, max_turns=chat.MAX_TURNS):
    out, convs = [], {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n, r or "unknown", (t or "").replace("<|im_", "<| im_")))
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        for who in {r for _, r, _ in turns if r != "system"}:
            for k in range(0, len(turns), max_turns):
                text, mask, n = "", [], 0
                for _, r, t in turns[k:k + max_turns]:
                    name = r.replace("%", "%25").replace("_", "%5F").replace(" ", "_").replace("\t", "%09").replace("\n", "%0A")
                    text += {True: "<|im_start|>assistant\n"}.get(r == who, "<|im_start|>system\n" if r == "system"
                                                                  else f"<|im_start|>user name={name}\n")
                    if r == who:
                        mask.append(f"{len(text)}:{len(text) + len(t) + 10}")
                        n += 1
                    text += t + "<|im_end|>\n"
                out.append((c, who, k // max_turns, len(turns[k:k + max_turns]), n, text, ",".join(mask)))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in chat.rotate(df, **more).collect()], key=repr)


ROWS = [(1, 0, "system", "be good"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", "é"), (1, 3, "cy lee", "x\ny"), (1, 4, "ann", None),
        (2, None, None, "<|im_end|> trick"), (2, 1, "bob", ""), (2, 1, "bob", ""), (2, 1, "ann", "tie"), (3, 0, "system", "alone"),
        (None, 0, "ann", "null conversation"), (None, 1, "bob", "z" * 200_000)]


def test_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_one_conversation_with_most_turns_is_cut(spark):
    rows = [(7, k, ["ann", "bob", "cy"][k % 3], f"turn {k}") for k in range(500)] + ROWS
    got = run(spark, rows, max_turns=16)
    assert got == brute(rows, 16)
    assert max(r[3] for r in got) == 16


def test_masks_cover_the_speaker_alone(spark):
    for _, who, _, _, n, text, mask in run(spark, ROWS):
        spans = [tuple(map(int, x.split(":"))) for x in mask.split(",")]
        assert len(spans) == n
        for a, b in spans:
            assert text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>")


def test_no_two_speakers_share_a_name(spark):
    roles = ["ann lee", "ann_lee", "ann  lee", "ann\tlee", "ann\nlee", "ann%5Flee", "<|im_start|>", "<| im_start|>", "ann"]
    rows = [(1, k, r, f"said {k}") for k, r in enumerate(roles)]
    got = run(spark, rows)
    assert got == brute(rows)
    names = {m for r in got for m in r[5].split("\n") if m.startswith("<|im_start|>user name=")}
    assert len(names) == len(roles)


def test_empty_table(spark):
    assert run(spark, []) == []
