"""Fixed values of the Korean text rules: word lists, patterns and constants that results depend on.

Longer stop lists are a parameter: pass your own to the functions that take ``stopwords``.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------

#: Opening and closing marks around a block of memory in a sent message; older pairs follow newer ones.
MARKERS = (("<!--MEMORY-->", "<!--/MEMORY-->"), ("<!--MEMORY_CONTEXT_START-->", "<!--MEMORY_CONTEXT_END-->"))
#: Marks of the trailing block that the earlier format appended to a message.
TAIL_MARKS = ("<!--MEMORY_TAIL_START", "MEMORY_TAIL_END-->")

MESSAGE_LIMIT = 2000
PIN_BUDGET = 700
LORE_BUDGET, LORE_SHARE = 600, 0.55
NOTE_BUDGET = 300
CURRENT_NOTES = 5
BM25_K1, BM25_B = 1.2, 0.75
PREFIX_CREDIT = 2.5
TOPIC_FLOOR, TOPIC_WEIGHT = 0.15, 4.0
RRF_BASE = 60

#: Particles and endings that may follow a keyword, longest first.
KEYWORD_PARTICLES = (
    "으로부터 에게서는 한테서는 이잖아 이었다 이에요 이라면 이라고 이라는 에게서 한테서 에서는 으로는 께서 에게 한테 에서 으로 로서 로써 "
    "부터 까지 보다 처럼 만큼 이랑 하고 이라 이며 이고 이나 이든 이야 이다 였다 라고 라는 라면 인데 인가 인지 잖아 에요 예요 라도 마저 조차 "
    "밖에 대로 뿐 들 은 는 이 가 을 를 의 에 께 도 만 와 과 랑 로 아 야 여 씨 님 요 다 인 나"
).split()
#: Particles dropped from words of facts, from salient words, from card keywords, and from words of the earlier index.
FACT_PARTICLES = "에서 에게 으로 이다 였다 이며 이고 은 는 이 가 을 를 의 과 와 에 로 도 만".split()
SALIENT_PARTICLES = "에서 으로 에게 에는 보다 처럼 까지 부터 하고 이며 이고 과 와 의 은 는 이 가 을 를 도 만 로 에".split()
CARD_PARTICLES = "에서 으로 에게 에는 보다 처럼 까지 부터 하고 이며 이고 의 은 는 이 가 을 를".split()
EARLIER_PARTICLES = "으로 에서 에게 처럼 까지 부터 만큼 조차 마다 은 는 이 가 을 를 의 에 와 과 도 만 로".split()
EARLIER_STOP = "그리고 하지만 그래서 그런데 지금 오늘 이번 현재 정말 조금 있다 없다 한다 했다 there this that with from".split()
EARLIER_ANCHOR_STOP = "그렇게 그랬다 했는데 있었다 말했다 하는데 이제는 그녀는 그들은 자신의 했다는 그것은 그대로 다시 진짜 계속".split()
RECALL_CUES = "기억 전에 예전 지난 그때 처음 언제 어디 뭐야 뭐였 무슨 누구 어떻게 왜".split()

#: Verb classes of lore relations, each a pattern, in order.
VERB_CLASSES = (
    ("sibling", "언니|누나|동생|형제|자매|가족"), ("wield", "무기|검은|검을|창은|쓰는|사용|휘두"), ("entrust", "맡겼|맡긴|맡기|맡김"),
    ("receive", "받은|받았|얻은|얻었"), ("store", "보관|맡아둔|맡아 둔"), ("hide", "숨긴|숨겨|숨겼|감춘"), ("open", "열 수|열어|여는|봉인 해제"),
    ("signal", "신호|봉화|연기"), ("heal", "치료|회복|출혈|상처"), ("poison", "독|마비"), ("prove", "증명|진위|허가"), ("allow", "통행|건너|넘으"), ("trade", "거래|교환"),
)
DOMAINS = ("인물", "장소", "기술", "사건/약조", "개념")
PERSON, CONCEPT = "인물", "개념"
KIND_WEIGHTS = {"약속": 0.2, "비밀": 0.2, "관계": 0.15, "설정": 0.15, "상태": 0.1, "경험": 0.05}
CHANGING_KINDS = ("상태", "관계")
KIND_WORDS = "약속 비밀 관계 상태 설정 경험 목표 사건 정보".split()
PRONOUNS = "나 저 너 당신 우리 저희 그 그녀 그들 그녀들 상대 상대방 사용자 유저".split()
LOCATIONS = "연무장 정원 저택 훈련장 의무실 거리 숲 성 연구실 탑 대련장 수련장 아카데미 본관 식당".split()
STATES = ("부상", "피로", "내상", "마력 고갈", "근육통", "치료", "휴식", "완쾌", "호전", "이상", "경계", "신뢰", "약속", "약조", "승리", "패배")
SKILL_PARTS = "검 스킬 마법 법 진격 분진 오러 강신 경화 이능 환도 종참 세이버 롱소드 검리 검초".split()
EVENT_PARTS = "약속 치료 대련 승리 부상 피로 청무제 결투 약조".split()
DOMAIN_ORDER = {"인물": 100, "기술": 80, "장소": 70, "사건/약조": 60, "개념": 30}
STATUS_FIELDS = "상태 능력 등급 스킬 호감도 친밀도 소지품 인벤토리 물자 목표 위치 장소 시간 날짜 일정 직업 레벨 체력 마력 스탯 관계 인연 속보 답변 퀘스트 보상 획득 소모 현재 진행 요약".split()
CROWD_SPEAKERS = "남자 여자 소년 소녀 노인 아이 사람 사람들 군인 병사 생존자 무전 목소리 일동 모두 학생 학생들 주민 행인 군중 누군가".split()
SYSTEM_LABELS = (
    "속보 목표 보상 경고 알림 시스템 퀘스트 미션 튜토리얼 상태 정보 위치 장소 시간 날짜 현재 결과 조건 효과 설명 메시지 안내 공지 주의 획득 레벨 등급 칭호 업적 스탯 "
    "능력치 호감도 관계 진행 기록 로그 이름 나이 직업 소속 종족 성별 외형 성격 특징 체력 마력 골드 아이템 소지품 스킬 버프 디버프 판정 주사위"
).split()
OVERVIEW_FIELDS = ("장소·동행", "진행 중", "관계", "미해결")
POINTING = "그거|그것|그걸|그게|그 사람|그사람|그분|걔|그 녀석|그놈|그년|아까|그때|저번|지난번|전에|거기|그곳|그 일|그일|그 얘기|그얘기"
#: Sentence weights of a window: gestures, undercurrents, turning points.
GESTURES = "걸음|가까워|다가서|물러서|거리감|거리를|시선|눈길|표정|손을|고개"
UNDERCURRENTS = "고집|걱정|단호|동요|의식한|담담|망설|어조|목소리|힘이 실려|제발|진심|안도"
TURNS = "돌파|승리|결착|인정|비밀|치료|의무실|약속|약조|지금 바로|나중에가 아니라"
INNER = r"생각했다|느껴졌다|알 수 없었다|바람이|턴 \d+"
NO_FACT = "상황 전개 및 대화 교류 지속"
#: Rejections of facts: copied speech, no predicate, empty promises, no information, glances, hearsay.
SPEECH_END = "(?:요|니다|까|죠)[.!?…\"」』\\s]*\\z"
PREDICATE_END = "(?:다|음|함|됨|임|요|죠)[.!?…\"」』)\\s]*\\z"
FOLLOWS = r"다음과\s*같이|아래와\s*같이"
NO_INFORMATION = r"(?:정보|언급|내용|기록)(?:가|이|는)?\s*없(?:음|다|었다)"
GLANCE = r"(?:시선|눈길|눈빛|표정|미소|한숨|고개|감탄|놀라움|당혹)(?:을|를|이|가)?\s*(?:\S+\s*)?(?:던졌|보냈|지었|지어\s*보였|끄덕|숙였|돌렸|보였|표했|드러냈|흘렸)"
HEARSAY = "(?:더라|더군|더라고|나\\s*보다|가\\s*보다|모양이다|듯하다|듯했다|것\\s*같다|것\\s*같았다)[.!?…\"」』\\s]*\\z"
REACTION = r"느꼈다|느낀다|느끼는|느끼며|궁금해|경악|당혹|헛웃음|웃음을|미소|한숨|표정으로|어이가\s*없|감탄|놀랐|놀라며|반짝였|빛을\s*띠"
VAGUE_EVENT = r"(?:에\s*대해|에\s*관해|관련(?:된|하여|해))\s*(?:이야기|대화|논의|얘기)|(?:이야기|대화)를\s*나눴"
VAGUE_SUBJECT = r"^(?:상대방?|사용자|유저|그녀|그|그들|그녀들)(?:은|는|이|가|의|을|를|에게)?(?:\s|\z)"
ADJECTIVAL = "한|하다|하게|하고|하여|해|했|히|함|하지|할|합"
PERSON_PARTICLES = "은|는|이|가|에게|한테|와|과|씨|님|야|아"
TECHNICAL = "lsa|nlp|bm25|gemini|프롬프트|인젝션|키워드|로컬분석"

# --- defaults ----------------------------------------------------------------------------

#: A short default stop list for names and salient words; pass a longer one for a given story.
STOPWORDS = (
    "SYSTEM INFO STATUS OOC 대사 감정 생각 행동 출력 프롬프트 지침 지시 규칙 유저 안내 명령 설정 기록 그리고 하지만 그러나 그런데 그래 이제 그냥 다음 아마 시간 모두 "
    "그렇게 아무 혼자 결국 다른 여기 어디 오늘 어제 매일 먼저 사실 그게 그건 마음 표정 눈빛 목소리 어깨 얼굴 자신 사람 모습 순간 지금 하나 때문 우리 그녀 이것 저것 "
    "어떤 모든 통해 위해 정도 다시 정말 진짜 조금 가장 매우 너무 아주 함께 서로 말했다 했다 였다 있다 없다 된다 한다 않았다 보였다 웃었다"
).split()
