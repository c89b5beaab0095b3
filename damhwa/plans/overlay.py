"""Synthetic Korean dialogue laid over the driver's tables, which hold none. Every line and scene here is our own.

Line i of a conversation or document is taken from LINES by a fixed formula, in Spark and in the oracles alike, so rules
meet positive and negative cases in data of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = (
    "오늘 회의는 세 시에 시작합니다.", "응, 알았어.", "그래.", "진짜?", "창문 좀 닫아 주세요.", "어제 산 우산을 또 잃어버렸어요.", "야, 너 어디 가?", "빨리 말해!",
    "서류를 내일까지 제출하세요.", "그건 안 돼.", "불가능하다고 몇 번을 말씀드립니까?", "죄송합니다만 잠시 기다려 주시겠어요?", "혹시 시간이 괜찮으시면 부탁 하나 드려도 될까요?", "너는 그냥 참아.", "내가 평생 지켜 줄게, 절대 걱정하지 마.", "무조건 다 해결해 줄 테니까 꼭 믿어.",
    "좋아해, 우리 운명 같지 않아?", "나는 원래 차가운 사람이야, 그게 내 매력이지.", "ㅋㅋ 그 농담은 좀 웃기다.", "카톡으로 지도 보내 줘.", "인스타 알고리즘이 또 바뀌었네.", "학생은는 교실에 있어요.", "책을를 두 권 샀어요.", "그리고 그리고 우리는 떠났어.",
    "고맙습니다 그런데 왜 늦었냐", "같이 가하자요.", "그렇게 하면 되요.", "나 이제 어떻해.", "그건 제 것이 아니예요.", "오늘이 몇일이지?", "이따가 다시 전화할께.", "정말 오랫만이네요.",
    "금새 비가 그쳤어.", "지금 갈려고 했어.", "나도 할수있어.", "친구한데 들었어.", "웬지 기분이 이상해.", "그러면 안되요.", "나는 못해.", "비가 올 것같아.",
    "지금 밥 먹고있어.", "나는 이 계획이 옳다고 생각한다.", "그것은 아주 중요한 열쇠입니다.", "우리는 성공하는 것을 원합니다.", "이제 결정을 만들 때다.", "그는 문제를 가지고 있다.", "내일 회의를 가지자.", "이 다리는 장인에 의해 만들어지었다.",
    "그 기억은 잊혀진 채로 남았다.", "서울에서의 밤은 길었다.", "데이터는 다른 사실을 보여 준다.", "나에게 말해 줘.", "좋은 시간을 보내세요.", "그녀는 웃었고 그는 울었다.", "나는 기다리고 있어.", "너도 지켜보고 있네.",
    "결론적으로 우리가 졌어.", "따라서 다시 시작해야 하고, 결론적으로 더 서둘러야 합니다.", "내가 만난 가는 사람은 오던 길을 본 적이 없는 아이였다.", "문을 연 한 사람이 멈춘 간 곳을 지나는 된 자리에 섰다.", "기다려 — 아직 끝나지 않았어.", "핵심은 속도가 아니라 방향이라는 것이다.", "결국 중요한 것은 마음이지.", "이것이 우리가 바라던 것이다.",
    "그는 떠난 것으로 보인다.", "비가 왔다.", "문이 닫혔다.", "아무도 없었던 것으로 보인다.", "불이 꺼졌다.", "나는 저를 믿었고 너는 나를 봤어, 당신은 저는 모른다고 했지.", "환불 요청은 취소되었습니다, 고객님.", "제가 왜 그래야 하죠?",
    "많이 힘들었겠다, 괜찮아?", "그냥 잊어, 그렇게 해야 편해.", "선생님께서는 언제 오십니까?", "저희 엄마가 감사하다고 전해 달래요.", "문의하신 주문은 상담 중에 있습니다.", "헐.", "맞아.", "아니.",
    "지난여름 바닷가에서 주운 조개껍데기를 아직도 책상 서랍에 넣어 두고 가끔 꺼내 보면서 그날 들었던 파도 소리와 네가 불러 주던 노래를 떠올리곤 해요.",
    "이 왕국의 역사를 처음부터 설명하자면 먼저 세 개의 강과 일곱 개의 산을 말해야 하고, 그다음에는 산마다 살던 부족과 그들이 섬기던 신의 이름을, 또 그 신들이 서로 다투다가 하늘을 갈라 놓은 밤과 그 밤에 태어난 아이들이 어떻게 첫 번째 궁궐을 지었는지를 빠짐없이 이야기해야 하며, 마지막에는 그 궁궐이 왜 바다 밑으로 가라앉았는지, 누가 열쇠를 쥐고 달아났는지까지 밝혀야 합니다.",
    "거절하겠습니다.", "오래 기다리셨지요.", "네.", "도와주셔서 고맙습니다.",
)

#: scene, medium, genre, character_profiles, relationship_boundaries
SCENES = (
    ("고객 센터 창구", "게임", "현대", "상담원과 손님", "초면, 민원 접수"),
    ("장례식장 복도", "드라마", "현대", "옛 친구", "오랜 동료"),
    ("궁궐 뜰", "웹소설", "사극", "왕과 신하", "군주와 신하"),
    ("교실", "웹툰", "학원", "동급생", "친한 친구"),
    ("부엌", "드라마", "일상", "엄마와 딸", "가족"),
    ("면접장", "영화", "현대", "지원자와 팀장", "공식 관계, 상사"),
    ("길모퉁이", "", "", "", ""),
    ("병실", "드라마", "현대", "환자와 보호자", "위로가 필요한 감정"),
    ("폐허가 된 성", "게임", "판타지", "용병 둘", "반존대, 의도된 거리"),
    ("카페", "단편", "로맨스", "헤어진 연인", "이별 뒤의 갈등"),
    ("환불 창구", "숏폼", "현대", "점원과 손님", "고객, 불만과 항의"),
    ("훈련장", "웹소설", "무협", "스승과 제자", "선배와 후배"),
)


def line_at(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LINES)), (index % len(LINES)).cast("int") + 1)


def conversation_items(conversations: DataFrame) -> DataFrame:
    """items(scene_id, item_idx, item): each turn's line with its role as speaker."""
    text = F.concat(F.coalesce("role", F.lit("-")), F.lit(": "), line_at(F.col("conv_id") * 7 + F.col("turn") * 3))
    return conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("scene_id"), F.col("turn").alias("item_idx"), text.alias("item"))


def scenes(conversations: DataFrame) -> DataFrame:
    """scenes(scene_id, scene, medium, genre, character_profiles, relationship_boundaries), one row a conversation."""
    names = ("scene", "medium", "genre", "character_profiles", "relationship_boundaries")
    row = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in SCENES]), (F.col("scene_id") % len(SCENES)).cast("int") + 1)
    return conversations.where("conv_id is not null").select(F.col("conv_id").alias("scene_id")).distinct().select("scene_id", row.alias("s")).select("scene_id", "s.*")


def document_utterances(documents: DataFrame, dataset: str = "lang") -> DataFrame:
    """utterances(dataset, doc_id, pos, text, context_blob): one for each line of a document, text from LINES."""
    pos = documents.select(F.col(dataset).alias("dataset"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    blob = F.element_at(F.array(*[F.lit(s[4]) for s in SCENES]), (F.col("doc_id") % len(SCENES)).cast("int") + 1)
    return pos.select("dataset", "doc_id", "pos", line_at(F.col("doc_id") * 13 + F.col("pos")).alias("text"), blob.alias("context_blob"))
