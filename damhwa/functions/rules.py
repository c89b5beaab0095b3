"""The Korean rule pack: patterns and thresholds as data, and their two regular-expression dialects."""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------------------------------
# Fixed values. Results depend on these patterns, names, confidences and bounds being exactly so.

HAPSYO = r"(습니다|습니까|십시오|입니다|입니까|ㅂ니다)[.!?…]*$"
HAEYO = r"(요|예요|이에요|해요|네요|군요|죠|까요|나요)[.!?…]*$"
BANMAL = r"(어|아|야|지|니|냐|네|군|자|마|거든|잖아|다)[.!?…]*$"
SPEAKER = r"^\s*[^:\n]{1,20}:\s*"

CALIBRATION_LINE = {
    "informal_address": r"(야|너|니가|네가|자기야)",
    "advice": r"(해야|해라|하지 마|그냥|당장|무조건|꼭|잊어|참아|버텨)",
    "overpromise": r"(항상|영원히|절대|무조건|다 해결|내가 해결|평생)",
    "intimacy": r"(사랑|좋아해|내 사람|운명|평생|안아|키스)",
    "cringe": r"(내 매력|나는 원래|심장이|영혼|세상에서 제일|운명처럼)",
    "humor": r"(ㅋㅋ|ㅎㅎ|농담|드립|개그|웃기)",
    "modern_term": r"(카톡|디엠|DM|인스타|밈|구독|알고리즘|업로드|스마트폰|셀카)",
    "buffer": r"(죄송|미안|실례|괜찮으시면|혹시|잠시|부탁|양해|감사|고맙|확인해\s*보|확인해보|확인하겠|확인드리|확인해\s*드리|먼저|가능하실까요|주시겠|주실 수|드리|도와)",
    "command": r"(?:빨리\s*|당장\s*|그냥\s*)?(해|와|가|앉아|기다려|말해|내놔|줘|보내|나가|들어와|그만해|조용히 해)[.!?…]*$",
    "blunt_refusal": r"(안\s*돼|안됩니다|못\s*해요|불가능|그건\s*안|싫어요|몰라요|제가\s*왜|어쩌라고)",
    "unsoftened_request": r"(?:빨리\s*|당장\s*|그냥\s*)?.{0,16}(하세요|해요|말하세요|기다리세요|보내세요|제출하세요|확인하세요)[.!?…]*$",
}

CALIBRATION_CONTEXT = {
    "serious": r"(장례|사망|죽|위험|피|울|실패|부상|이별|배신)",
    "old_world": r"(사극|조선|고려|중세|고대|왕국|궁궐|무협|판타지)",
    "formal": r"(초면|상사|고객|공식|면접|선배|스승|군주|왕|어른|연장자|교수|선생|거래처|민원|환자|보호자|사장|팀장|부장)",
    "shift": r"(반존대|전환|일부러|의도|거리|친해|무너)",
    "event": r"(실수|늦|지각|사과|불만|항의|환불|민원|거절|부탁|요청|고객|고장|문제|취소)",
}

SOFT_MAX, HARD_MAX, SCENE_MIN, SCENE_MAX = 60, 120, 6, 20

ACTS = {
    "question": r"(\?|까요|나요|습니까|니[?!.…\s]*$|냐[?!.…\s]*$)",
    "command": r"(하세요|해라|기다려|보내세요|제출하세요|확인하세요|내놔|그만해)",
    "request": r"(부탁|주세요|주실 수|주시겠|가능하실까요|해 주|도와)",
    "refusal": r"(안\s*돼|안됩니다|못\s*해요|불가능|싫어요|거절)",
    "apology": r"(죄송|미안|사과|실례)",
    "gratitude": r"(감사|고맙)",
    "empathy": r"(속상|힘들|괜찮|이해|그랬구나|걱정|불안|슬프|화나)",
    "advice": r"(해야|해라|그냥|꼭|추천|좋겠|하지 마|참아|버텨)",
    "overpromise": r"(항상|절대|무조건|다 해결|내가 해결|평생|영원히)",
    "polite_buffer": r"(죄송|미안|실례|괜찮으시면|혹시|잠시|부탁|양해|감사|고맙|확인해\s*보|먼저|가능하실까요|주시겠|주실 수|드리)",
}
MARKERS = ("apology", "gratitude", "empathy", "polite_buffer")

CONTEXTS = {
    "customer_complaint": r"(고객|환불|민원|불만|항의|문의|상담|주문|고장|취소)",
    "formal_first_meeting": r"(초면|처음|공식|면접|고객|상사|거래처|교수|선생|사장|팀장|부장)",
    "hierarchy": r"(상사|선배|후배|교수|선생|팀장|부장|어른|연장자|군주|왕)",
    "empathy_support": r"(위로|힘들|속상|슬프|우울|걱정|불안|화나|감정|상처)",
    "friends": r"(친구|동료|친한|동급생)",
    "family": r"(가족|엄마|아빠|부모|동생|형|누나|언니|오빠)",
    "conflict": r"(갈등|싸움|다툼|화해|사과|잘못|배신)",
    "refusal": r"(거절|안\s*돼|안됩니다|불가능|못\s*해요)",
    "request": r"(부탁|요청|주세요|주시|가능하실까요)",
}
POLITENESS_CONTEXTS = ("customer_complaint", "formal_first_meeting", "hierarchy", "request", "refusal")

_COLLISION = r"(?:습니다|습니까|세요|요).{0,20}(?:야|냐|니|잖아|거든|해라)[.!?…]*$|(?:야|냐|니|잖아|거든).{0,20}(?:습니다|습니까|세요|요)[.!?…]*$"

GRAMMAR = {
    "duplicate_particle_sequence": r"(?<=[가-힣])(?:은는|는은|을를|를을|가가|이이|에에|도도|만만|에서에서|에게에게)(?=$|\s|[,.!?…])",
    "duplicate_connective": r"(그리고\s+그리고|하지만\s+하지만|그래서\s+그래서)",
    "sentence_ending_collision": _COLLISION,
    "nonstandard_polite_ending": r"(습니다요|습니까요|했어요요|해요요|하자요|보자요|먹자요|만나자요|그만하자요)[.!?…]*$",
    "doe_dwae_confusion": r"(되요|됬|됄|안되(?:요|나요|네|는|면|겠|다|고|지|잖|어서|어|니|나|게|$))",
    "eotteokhae_misspelling": r"(어떻해|어떡게|어떻게해)",
    "anieyo_misspelling": r"(아니예요|아녜요)",
    "myeochil_misspelling": r"몇일",
    "halge_misspelling": r"(할께|갈께|볼께|줄께|먹을께|해줄께)",
    "oraenman_misspelling": r"오랫만",
    "geumse_misspelling": r"금새",
    "intent_l_euryeogo": r"(할려고|갈려고|볼려고|먹을려고|오려고|만날려고|줄려고|하려고자)",
    "bound_noun_spacing": r"(수있|수없|것같|거같|줄알|줄모르)",
    "nonstandard_hante_spelling": r"(한태|나한데|너한데|친구한데|엄마한데|아빠한데)",
    "waen_wen_confusion": r"웬지|왠\s*(?:일|말|사람|것|곳|쪽|경우|상황|소리)",
    "an_dwae_spacing": r"안되(?:요|나요|네|는|면|겠|다|고|지|잖|어서|어|니|나|게|$)",
    "mot_spacing_suspect": r"못(?:해|하|되|가|오|먹|보|읽|찾|참|자|들)",
    "bound_noun_spacing_expanded": r"(?:것|거)같|수(?:있|없)|줄(?:알|모르)",
    "auxiliary_spacing_suspect": r"(?:하고|되어|돼|가고|오고|보고|먹고|살고|읽고|찾고)있",
    "honorific_ending_collision": _COLLISION,
}

TRANSLATIONESE = {
    "explicit_i_think": r"(나는|저는|제가|내가).{0,24}(생각한다|생각해요|생각합니다|생각해)",
    "thing_pronoun_overuse": r"(그것은|이것은|저것은|그건|이건|저건).{0,24}(이다|입니다|이에요|예요)",
    "want_to_do_literalism": r"하는\s+것을\s+(원해|원합니다|바라|바랍니다)",
    "make_decision_literalism": r"결정을\s+만들",
    "have_problem_literalism": r"문제를\s+가지고\s+있",
    "have_make_literalism_expanded": r"(회의|시간|기회|선택|결정|의미|문제)(?:을|를)\s+(?:가지|가졌|갖|만들|내리)",
    "by_passive_literalism": r"에\s*의(?:해|하여)\s+\S{0,12}?(?:되|받|당하|지)(?:다|었|어|는|ㄴ다|는다|요|습니다)",
    "double_passive_literalism": r"(되어진|보여진|잊혀진|쓰여진|닫혀진|열려진|불려진|놓여진)",
    "double_particle_literalism": r"(?:에서의|에로의|으로의|에의|으로부터의|로부터의)",
    "inanimate_subject_literalism": r"(?:데이터|결과|분석|기술|정책|보고서|시스템)(?:은|는|이|가).{0,30}(?:보여|시사|드러내|제시|말해|의미)",
    "tell_me_literalism": r"(나에게|저에게|너에게)\s+말해",
    "good_time_literalism": r"좋은\s+시간을\s+보내",
}

RHYTHM = {
    "em_dash_punctuation": r"—",
    "formulaic_contrast_frame": r"(핵심은.{0,40}(?:아니라|아니다)|중요한\s+(?:것은|건).{0,40}(?:아니라|아니다)|단순히.{0,40}아니라)",
    "formulaic_transition_frame": r"(결국\s+중요한\s+(?:것은|건)|(?:꽤\s+)?흥미로운\s+지점)",
}

COUNTED = {
    "third_person": r"(?:그녀(?:는|가|를|의|에게|와|도|만)?|그것(?:은|이|을|의|에|에게)?|그들(?:은|이|을|의|에게|과|도)?|그(?:는|가|를|의|에게|와|도|만)(?=\s|[,.!?…]|$))",
    "progressive": r"고\s*있(?:다|어|어요|습니다|었|는|을|던|네|지)",
    "discourse": r"(결론적으로|따라서|이를\s*통해|그러므로|요약하면|정리하면)",
    "clause": r"[가-힣]+(?:ㄴ|는|ㄹ|던|한|된|할|될|온|간)\s+[가-힣]",
    "pronoun": r"(나는|저는|제가|내가|나를|저를|너는|너를|당신은|당신을)",
}

DA_ENDING = r"(?:다|한다|된다|이다|었다|았다|였다)[.!?…]*$"
ENDING_KEY = r"([가-힣]{1,3})[.!?…]*$"
WRITTEN_ENDING = r"(것이다|것입니다|것으로 보인다|라고 생각한다|라고 판단된다|라고 할 수 있다)[.!?…]*$"
REACTION = r"^(응|어|아|그래|맞아|아니|헐|뭐|진짜|괜찮아|그렇지)[.!?…]*$"

LENGTH_BOUNDS, TURN_BOUNDS = (10, 30, 60, 120, 240), (1, 3, 5, 10, 20, 40)

AXES = ("naturalness", "character_voice", "relationship_fit", "speech_level_consistency", "genre_fit", "cringe_risk", "humor_timing", "anachronism_risk")
NATURALNESS_AXES = ("grammar_acceptability", "native_korean_idiom", "spoken_korean_rhythm")

#: signal: (category, severity, scope)
SIGNAL_METADATA = {
    "duplicate_particle_sequence": ("grammar", "medium", "line"),
    "duplicate_connective": ("grammar", "low", "line"),
    "sentence_ending_collision": ("grammar", "high", "line"),
    "nonstandard_polite_ending": ("grammar", "high", "line"),
    "doe_dwae_confusion": ("spelling", "high", "line"),
    "eotteokhae_misspelling": ("spelling", "high", "line"),
    "anieyo_misspelling": ("spelling", "medium", "line"),
    "myeochil_misspelling": ("spelling", "medium", "line"),
    "halge_misspelling": ("spelling", "medium", "line"),
    "oraenman_misspelling": ("spelling", "medium", "line"),
    "geumse_misspelling": ("spelling", "medium", "line"),
    "intent_l_euryeogo": ("grammar", "medium", "line"),
    "bound_noun_spacing": ("spacing", "medium", "line"),
    "nonstandard_hante_spelling": ("spelling", "medium", "line"),
    "waen_wen_confusion": ("spelling", "medium", "line"),
    "an_dwae_spacing": ("spacing", "medium", "line"),
    "mot_spacing_suspect": ("spacing", "low", "line"),
    "bound_noun_spacing_expanded": ("spacing", "medium", "line"),
    "auxiliary_spacing_suspect": ("spacing", "low", "line"),
    "honorific_ending_collision": ("speech_level", "high", "line"),
    "explicit_i_think": ("translationese", "medium", "line"),
    "thing_pronoun_overuse": ("translationese", "medium", "line"),
    "want_to_do_literalism": ("translationese", "medium", "line"),
    "make_decision_literalism": ("translationese", "medium", "line"),
    "have_problem_literalism": ("translationese", "medium", "line"),
    "have_make_literalism_expanded": ("post_editese", "medium", "line"),
    "by_passive_literalism": ("post_editese", "medium", "line"),
    "double_passive_literalism": ("post_editese", "high", "line"),
    "double_particle_literalism": ("post_editese", "medium", "line"),
    "inanimate_subject_literalism": ("post_editese", "medium", "line"),
    "tell_me_literalism": ("translationese", "medium", "line"),
    "good_time_literalism": ("translationese", "medium", "line"),
    "third_person_pronoun_literalism": ("post_editese", "medium", "scene"),
    "relative_clause_stack": ("post_editese", "medium", "line"),
    "progressive_aspect_cluster": ("post_editese", "low", "scene"),
    "ai_discourse_marker_cluster": ("ai_draft_rhythm", "medium", "scene"),
    "da_ending_streak": ("spoken_rhythm", "medium", "scene"),
    "em_dash_punctuation": ("ai_draft_rhythm", "low", "line"),
    "formulaic_contrast_frame": ("ai_draft_rhythm", "medium", "line"),
    "formulaic_transition_frame": ("ai_draft_rhythm", "medium", "line"),
    "written_register_cluster": ("spoken_rhythm", "medium", "scene"),
    "missing_short_reaction_turns": ("spoken_rhythm", "low", "scene"),
    "explicit_pronoun_overuse": ("translationese", "low", "scene"),
}

SUGGESTIONS = {
    "spelling_review": ("doe_dwae_confusion", "eotteokhae_misspelling", "anieyo_misspelling", "myeochil_misspelling", "halge_misspelling", "waen_wen_confusion"),
    "spacing_review": ("an_dwae_spacing", "mot_spacing_suspect", "bound_noun_spacing", "bound_noun_spacing_expanded", "auxiliary_spacing_suspect"),
    "speech_level_review": ("honorific_ending_collision",),
    "punctuation_rhythm_review": ("em_dash_punctuation",),
    "formulaic_phrase_review": ("formulaic_contrast_frame", "formulaic_transition_frame"),
    "native_collocation_review": ("have_make_literalism_expanded",),
    "voice_rewrite_review": ("by_passive_literalism", "double_passive_literalism"),
    "particle_simplification_review": ("double_particle_literalism",),
    "subject_rewrite_review": ("inanimate_subject_literalism",),
    "pronoun_omission_or_naming_review": ("third_person_pronoun_literalism",),
    "sentence_split_review": ("relative_clause_stack",),
    "aspect_simplification_review": ("progressive_aspect_cluster",),
    "discourse_marker_review": ("ai_discourse_marker_cluster",),
    "spoken_ending_review": ("da_ending_streak",),
}

#: hint: (axis, confidence, signals, condition over a scene's counts and contexts, the signal whose lines it cites)
CALIBRATION_HINTS = {
    "very_long": ("naturalness", 0.82, ("exposition_density_risk", "very_long_utterance"), "n_very_long > 0", "very_long"),
    "medium_density": ("genre_fit", 0.74, ("medium_density_risk",), "n_very_long > 0", "very_long"),
    "long_cluster": ("naturalness", 0.68, ("long_utterance_cluster",), "n_very_long = 0 AND n_long > 0 AND avg_chars > soft_max", "long"),
    "mixed_speech": ("speech_level_consistency", 0.8, ("mixed_speech_levels_without_context_trigger",), "known_levels >= 2 AND NOT shift", "known_level"),
    "overfamiliar": ("relationship_fit", 0.76, ("overfamiliar_address_in_formal_context",), "formal AND n_informal_address > 0", "informal_address"),
    "direct_command": ("relationship_fit", 0.78, ("direct_command_in_polite_context",), "formal AND n_bare_command > 0", "bare_command"),
    "unsoftened_request": ("relationship_fit", 0.68, ("unsoftened_request_in_polite_context",), "formal AND n_bare_request > 0", "bare_request"),
    "blunt_refusal": ("relationship_fit", 0.73, ("blunt_refusal_without_buffer",), "event AND n_bare_refusal > 0", "bare_refusal"),
    "missing_buffer": ("relationship_fit", 0.58, ("missing_apology_or_acknowledgement_in_service_context",), "formal AND event AND line_count > 0 AND n_buffer = 0", None),
    "advice_overpromise": ("relationship_fit", 0.7, ("advice_overload", "overpromise_risk"), "n_advice > 0 AND n_overpromise > 0", "advice_or_overpromise"),
    "intimacy": ("relationship_fit", 0.72, ("intimacy_jump",), "formal AND n_intimacy > 0", "intimacy"),
    "cringe": ("cringe_risk", 0.67, ("self_explanation_or_melodrama",), "n_cringe > 0", "cringe"),
    "humor": ("humor_timing", 0.73, ("humor_in_serious_scene",), "serious AND n_humor > 0", "humor"),
    "anachronism": ("anachronism_risk", 0.78, ("modern_term_in_old_world_context",), "old_world AND n_modern_term > 0", "modern_term"),
    "large_packet": ("genre_fit", 0.56, ("large_scene_packet",), "line_count > 20", None),
}

#: scene signal: (axis, condition, the line signal whose lines it cites)
SCENE_SIGNALS = {
    "third_person_pronoun_literalism": ("native_korean_idiom", "m_third_person >= 2", "third_person"),
    "progressive_aspect_cluster": ("native_korean_idiom", "m_progressive >= 2 AND line_count >= 2", "progressive"),
    "relative_clause_stack": ("native_korean_idiom", "n_clause_stack > 0", "clause_stack"),
    "ai_discourse_marker_cluster": ("spoken_korean_rhythm", "m_discourse >= 2", "discourse"),
    "da_ending_streak": ("spoken_korean_rhythm", "n_da_streak > 0", "da_streak"),
}
AXIS_CONFIDENCE = {"grammar_acceptability": 0.76, "native_korean_idiom": 0.72, "spoken_korean_rhythm": 0.58}

#: hint: (axis, confidence, condition, the signal whose lines it cites)
SCENE_HINTS = {
    "written_register_cluster": ("spoken_korean_rhythm", 0.67, "line_count >= 4 AND n_written >= 0.75 * line_count", "written"),
    "missing_short_reaction_turns": ("spoken_korean_rhythm", 0.61, "line_count >= 4 AND n_reaction = 0 AND min_chars > 12", None),
    "explicit_pronoun_overuse": ("native_korean_idiom", 0.6, "line_count > 0 AND m_pronoun >= 1.5 * line_count", "pronoun"),
}

#: signal: (axis, confidence, condition over matched contexts, acts and levels, the context whose baseline it cites, markers)
GUIDANCE = {
    "customer_complaint_refusal": ("relationship_fit", 0.78, "c_customer_complaint AND a_refusal AND NOT a_apology AND NOT a_polite_buffer", "customer_complaint", ("apology", "polite_buffer")),
    "formal_request_directness": ("relationship_fit", 0.7, "(c_formal_first_meeting OR c_hierarchy) AND (a_command OR a_request) AND NOT a_polite_buffer", "formal_first_meeting|hierarchy", ("polite_buffer",)),
    "empathy_advice_timing": ("relationship_fit", 0.66, "c_empathy_support AND a_advice AND NOT a_empathy", "empathy_support", ("empathy",)),
    "speech_level_context_mismatch": ("speech_level_consistency", 0.64, "known_levels >= 2 AND (c_formal_first_meeting OR c_hierarchy)", None, ()),
    "dialogue_density_outlier": ("naturalness", 0.62, "max_chars > density_threshold", None, ()),
}

# End of fixed values.
# ---------------------------------------------------------------------------------------------------------------------

#: Python's white space, for use inside brackets.
_JAVA_SPACE = r"\s\x1c-\x1f"
_RE2_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _spaces(pattern: str, members: str) -> str:
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(members if inside else f"[{members}]")
            at += 2
        elif two == r"\S":
            out.append(f"[^{members}]")
            at += 2
        elif two[0] == "\\":
            out.append(two)
            at += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at += 1
    return "".join(out)


def java(pattern: str) -> str:
    """The pattern for Spark: Unicode classes, and line ends as in the patterns' own dialect."""
    return "(?Ud)" + _spaces(pattern, _JAVA_SPACE)


def re2(pattern: str) -> str:
    """The pattern for an engine without look-around; matches the same lines, equally often."""
    return _spaces(pattern.replace("(?<=", "(?:").replace("(?=", "(?:"), _RE2_SPACE)
