from pyspark.sql import functions as F

from earmark.functions import keys, ranking, text, values, vectors
from earmark.operators.filters import gate, tradeoff_label, verdict


def col_of(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_keys(spark):
    assert col_of(spark, keys.source_key(F.lit(" ./data\\music_db\\a/b.mp3 "))) == "a/b.mp3"
    assert col_of(spark, keys.source_key(F.lit("../x.mp3"))) == "x.mp3"
    assert col_of(spark, keys.basename(F.lit("a\\b/c.mp3\n"))) == "c.mp3"
    assert col_of(spark, keys.cache_key(F.lit("/data/proj/data/music_db_15s/foo__seg001.mp3"))) == "foo__seg001.mp3"
    assert col_of(spark, keys.cache_key(F.lit("foo.mp3"))) == "foo.mp3"
    assert col_of(spark, keys.resolve_path(F.lit("a/./b.mp3"), "/root")) == "/root/a/b.mp3"
    assert col_of(spark, keys.resolve_path(F.lit("/abs/b.mp3"), "/root")) == "/abs/b.mp3"
    assert col_of(spark, keys.resolve_path(F.lit("data/music_db_15s/x.mp3"), "/root", staged_root="/tmp/stage")) == "/tmp/stage/x.mp3"
    assert col_of(spark, keys.clip_name(F.lit("a/b.flac"), F.lit(3))) == "a__b__seg003.mp3"
    assert col_of(spark, keys.clip_name(F.lit("a.b/.hidden"), F.lit(1000))) == "a.b__.hidden__seg1000.mp3"
    assert col_of(spark, keys.file_suffix(F.lit("x/Song.MP3"))) == ".mp3"
    assert col_of(spark, keys.file_suffix(F.lit(".bashrc"))) == "<no extension>"
    assert col_of(spark, keys.strip(F.lit("　 a  \n"))) == "a"


def test_blob_name_keeps_the_end_of_long_keys(spark):
    name = col_of(spark, keys.blob_name(F.lit("d/" + "k" * 200)))
    assert len(name) == 20 + 1 + 80 + 4 and name.endswith("k.npy")


def test_suffix_strip(spark):
    for given, want in (("piano music", "piano"), ("Relaxing MUSIC", "Relaxing"), ("orchestral", "orchestral"), (" music", "music"), ("musical music ", "musical")):
        assert col_of(spark, text.strip_music_suffix(F.lit(given))) == want


def test_caption_cases(spark):
    cases = {("a", "calm"): "a. mood: calm", ("a", " "): "a", ("", "calm"): "music mood calm", (None, None): "unknown music"}
    for (t, m), want in cases.items():
        assert col_of(spark, text.compose_caption(F.lit(t).cast("string"), F.lit(m).cast("string"))) == want


def test_tag_caption(spark):
    labels = F.create_map(F.lit("inst_piano"), F.lit(1), F.lit("mood_relaxing"), F.lit(1), F.lit("inst_vocal"), F.lit(0))
    assert tuple(col_of(spark, text.tag_caption(labels))) == ("piano, relaxing", "tag_primary")
    none = F.create_map(F.lit("inst_piano"), F.lit(0))
    assert tuple(col_of(spark, text.tag_caption(none))) == ("music", "tag_fallback")
    assert tuple(col_of(spark, text.tag_caption(F.lit(None).cast("map<string,int>")))) == ("music", "tag_no_gold")


def test_prompt_holds_its_fields(spark):
    prompt = col_of(spark, text.improve_prompt(F.lit("old caption"), F.lit("calm"), F.lit(0.7), F.lit("a/b.mp3"), F.lit(0.25)))
    for piece in ("old caption", "calm", "0.7", "a/b.mp3", "0.2500"):
        assert piece in prompt
    bare = col_of(spark, text.improve_prompt(F.lit("t"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(""), F.lit(None).cast("double")))
    assert bare.count("\n") == 2


def test_values(spark):
    assert col_of(spark, values.quantise_confidence(F.lit("1.7"))) == 1.0
    assert col_of(spark, values.quantise_confidence(F.lit("true"))) == 0.0
    assert col_of(spark, values.quantise_confidence(F.lit(0.126))) == 0.13
    assert col_of(spark, values.quantise_confidence(F.lit("0.7"))) == 0.7 and col_of(spark, values.quantise_confidence(F.lit("0.7"), from_text=False)) == 0.0
    assert col_of(spark, values.quantise_confidence(F.lit(0.7), from_text=False)) == 0.7
    assert [col_of(spark, values.parse_flag(F.lit(v))) for v in ("", " 1.0 ", "x", "2")] == [0, 1, 0, 2]
    assert [col_of(spark, values.parse_relevance(F.lit(v))) for v in ("", "2.5", "-1", "x")] == [None, 2.5, None, None]
    assert [col_of(spark, values.bin_value(F.lit(v))) for v in (79.9, 80.0, 120.0, 120.1)] == ["slow", "mid-tempo", "mid-tempo", "fast"]
    assert col_of(spark, values.array_mean(F.array().cast("array<double>"))) is None
    assert col_of(spark, values.mix_target(F.lit(65041), F.lit(6610), mix_ratio=0.5)) == 6610
    assert col_of(spark, values.mix_target(F.lit(100), F.lit(1000), mix_ratio=0.2)) == 25
    assert col_of(spark, values.mix_target(F.lit(100), F.lit(1000), explicit=7)) == 7
    assert col_of(spark, values.mix_target(F.lit(100), F.lit(1000), mix_ratio=None)) == 100


def test_model_response(spark):
    good = values.parse_response(F.lit('{"text": " a ", "mood": "", "confidence": 0.456}'), F.lit("k.mp3"))
    assert tuple(col_of(spark, good)) == ("k.mp3", "a", None, 0.46)
    for bad in ("{", "[1]", "", None):
        assert tuple(col_of(spark, values.parse_response(F.lit(bad).cast("string"), F.lit("k")))) == ("k", "", None, 0.0)


def test_gate(spark):
    def run(a, b, c, **kw):
        g = col_of(spark, gate(F.lit(a), F.lit(b), F.lit(c), **kw))
        return g["accepted"], g["reject_reason"]

    assert run(0.2, 0.5, 0.95) == (True, None)
    assert run(0.2, 0.5, 0.5) == (False, "drift")
    assert run(0.5, 0.4, 0.99) == (False, "sim")
    assert run(0.5, 0.4, 0.1) == (False, "sim")
    assert run(0.5, 0.5, 0.99) == (False, "sim")
    assert run(0.5, 0.5, 0.99, strict=False) == (True, None)


def test_tradeoff_and_verdict(spark):
    assert "Forgetting" in col_of(spark, tradeoff_label(F.lit(-0.02), F.lit(0.20), F.lit("inst_vocal")))
    assert "Specialization" in col_of(spark, tradeoff_label(F.lit(0.15), F.lit(-0.10), F.lit("inst_piano")))
    assert "hurts both" in col_of(spark, tradeoff_label(F.lit(-0.05), F.lit(-0.05), F.lit("inst_piano")))
    assert "No clear" in col_of(spark, tradeoff_label(F.lit(0.0), F.lit(0.12), F.lit("inst_vocal")))
    assert col_of(spark, tradeoff_label(F.lit(None).cast("double"), F.lit(0.1), F.lit("x"))) == "n/a"
    assert [col_of(spark, verdict(F.lit(d))) for d in (0.02, -0.02, 0.01)] == ["LLM arm better", "Original arm better", "Roughly tied"]


def test_random_hit(spark):
    import math

    def hit(n, r, k):
        return col_of(spark, ranking.random_hit(F.lit(n), F.lit(r), F.lit(k)))

    assert abs(hit(10, 3, 5) - (1 - math.comb(7, 5) / math.comb(10, 5))) < 1e-12
    assert hit(5, 5, 3) == 1.0 and hit(5, 0, 3) == 0.0 and hit(10, 3, 9) == 1.0 and hit(0, 0, 3) == 0.0


def test_zero_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert col_of(spark, vectors.unit(zero)) == [0.0, 0.0]
    assert col_of(spark, vectors.cosine(zero, zero)) == 0.0
    assert col_of(spark, vectors.squared_l2(F.array(F.lit(1.0), F.lit(2.0)), zero)) == 5.0
