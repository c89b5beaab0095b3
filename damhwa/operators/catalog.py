"""Static tables: rubric, prompts, resources, example cards, signals; hygiene and validation of what is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from damhwa.functions import rules

#: Our own wording of what each axis asks, at scores 5, 3 and 1.
RUBRIC = {
    "naturalness": ("reads as if spoken", "a few lines need a second reading", "reads as exposition"),
    "character_voice": ("each speaker could be told by voice alone", "voices blur at times", "all speak alike"),
    "relationship_fit": ("distance and courtesy fit the bond", "some lines are too close or too cold", "the bond is ignored"),
    "speech_level_consistency": ("shifts have reasons on the page", "a shift or two is unexplained", "levels change at random"),
    "genre_fit": ("length and breath suit the medium", "some lines run long for it", "another medium's dialogue"),
    "cringe_risk": ("feeling is shown", "some lines explain themselves", "melodrama throughout"),
    "humor_timing": ("jokes land where the scene allows", "a joke comes early or late", "jokes break a grave scene"),
    "anachronism_risk": ("words belong to the world", "one word out of place", "modern talk in an old world"),
}
PROMPTS = ("full_review", "voice_check", "relationship_check", "speech_level_check", "humor_pass", "genre_pass", "line_polish")
CATEGORIES = ("naturalness", "character_drift", "relationship_empathy_boundary", "speech_level", "humor_timing", "anachronism_genre")
CARD_KEYS = ("id", "category", "scene", "character_context", "relationship_context", "bad_line", "good_line", "why_bad", "why_good", "risk_tags", "source_basis")

#: Our own cards: category, scene, what is off, what is better.
CARDS = (
    ("naturalness", "부엌의 아침", "나는 지금 커피를 마시는 것을 원해.", "커피 마실래."), ("naturalness", "버스 정류장", "버스가 오고 있는 중에 있다.", "버스 온다."), ("naturalness", "도서관", "이것은 나의 책입니다.", "이거 내 책이야."), ("naturalness", "시장", "가격에 대해 이야기합시다.", "얼마예요?"),
    ("naturalness", "산길", "나는 피곤함을 느낀다.", "힘들다."), ("naturalness", "옥상", "별들이 보여진다.", "별 보인다."), ("naturalness", "전화", "당신은 누구입니까?", "누구세요?"), ("naturalness", "비 오는 날", "비에 의해 젖었다.", "비 맞았어."),
    ("character_drift", "작업실", "무뚝뚝한 장인이 길게 칭찬한다.", "쓸 만하네."), ("character_drift", "훈련장", "엄한 스승이 애교를 부린다.", "다시 해라."), ("character_drift", "재판정", "냉정한 검사가 흐느낀다.", "증거를 보시죠."), ("character_drift", "교실", "수줍은 전학생이 연설한다.", "저, 안녕."), ("character_drift", "선술집", "과묵한 용병이 수다를 떤다.", "값이나 치러."), ("character_drift", "병동", "침착한 의사가 소리친다.", "숨 쉬세요."),
    ("relationship_empathy_boundary", "창구", "그건 안 됩니다.", "죄송하지만 그건 어렵습니다."), ("relationship_empathy_boundary", "장례식", "힘내, 다 잘될 거야.", "옆에 있을게."), ("relationship_empathy_boundary", "면접", "야, 앉아.", "편히 앉으세요."), ("relationship_empathy_boundary", "첫 만남", "우리 평생 가자.", "다음에 또 봬요."), ("relationship_empathy_boundary", "병문안", "그러게 조심했어야지.", "많이 아팠지?"), ("relationship_empathy_boundary", "회사", "그냥 참아.", "무슨 일 있었어?"),
    ("speech_level", "회의", "알겠어, 부장님.", "알겠습니다, 부장님."), ("speech_level", "가게", "이거 줘요, 야.", "이거 주세요."), ("speech_level", "궁궐", "폐하, 그건 아니야.", "폐하, 아니 되옵니다."), ("speech_level", "카페", "먼저 갈게요, 너는?", "먼저 갈게, 너는?"), ("speech_level", "학교", "선생님, 이거 뭐야?", "선생님, 이게 뭐예요?"),
    ("humor_timing", "영안실", "농담 하나 할까?", "잠깐 앉자."), ("humor_timing", "이별", "ㅋㅋ 울지 마.", "미안해."), ("humor_timing", "전투", "개그는 나중에.", "뒤로 빠져."),
    ("anachronism_genre", "고려 주막", "카톡 해.", "기별하게."), ("anachronism_genre", "무협 산채", "업로드했소.", "방을 붙였소."),
)


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(axis, score, text) for axis, texts in RUBRIC.items() for score, text in zip((5, 3, 1), texts)], "axis string, score int, anchor string")


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p) for k, p in enumerate(PROMPTS)], "seq int, prompt string")


def signals(spark: SparkSession) -> DataFrame:
    """(signal, category, severity, scope, suggestion_type) of the naturalness signals."""
    kinds = {s: kind for kind, names in rules.SUGGESTIONS.items() for s in names}
    return spark.createDataFrame([(s, *m, kinds.get(s)) for s, m in rules.SIGNAL_METADATA.items()], "signal string, category string, severity string, scope string, suggestion_type string")


def cards(spark: SparkSession) -> DataFrame:
    rows = [(k, f"card-{k:02d}", category, scene, bad, good) for k, (category, scene, bad, good) in enumerate(CARDS, 1)]
    return spark.createDataFrame(rows, "seq int, id string, category string, scene string, bad_line string, good_line string")


def examples(spark: SparkSession, category: str | None = None, limit: int = 5) -> DataFrame:
    """Cards of a category in order; the limit is held to 1 to 30. An unknown category is a ValueError naming the known."""
    if category and category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}; known: {', '.join(CATEGORIES)}")
    rows = cards(spark)
    return (rows.where(F.col("category") == category) if category else rows).orderBy("seq").limit(max(1, min(30, limit)))


#: Field names under which source text would leak, and values that are no text.
FORBIDDEN = r"(?i)^\s*(text|utterance|utterances|raw_text|source_text|original_text|dialogue|conversation|summary|발화|원문|요약)\s*:\s*(.+?)\s*$"
ALLOWED = ("", "|", ">", "[]", "{}", "omitted", "not_included")


def forbidden_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """The rows of lines(..., line) that state a forbidden field with a value, with `field`; the line itself goes."""
    pattern = rules.java(FORBIDDEN.removeprefix("(?i)")).replace("(?Ud)", "(?Udi)")
    rows = lines.withColumn("field", F.regexp_extract(line, pattern, 1)).where("field <> ''")
    value = F.regexp_replace(F.trim(F.regexp_extract(line, pattern, 2)), "^['\"]+|['\"]+$", "")
    rows = rows.withColumn("_v", value).where(~F.col("_v").isin(*ALLOWED) & ~((F.col("_v").startswith("<")) & (F.col("_v").endswith(">"))))
    return rows.drop("_v", line)


def validate(spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
    """(check, ok): thirty cards, eight axes, and, given keys(id, key), each card's eleven keys."""
    out = [("cards", len(CARDS) == 30), ("axes", len(rules.AXES) == len(RUBRIC) == 8)]
    if keys is not None:
        missing = keys.groupBy("id").agg(F.collect_set("key").alias("have")).where(F.size(F.array_except(F.array(*map(F.lit, CARD_KEYS)), "have")) > 0)
        out.append(("card_keys", missing.limit(1).count() == 0))
    return spark.createDataFrame(out, "check string, ok boolean")
