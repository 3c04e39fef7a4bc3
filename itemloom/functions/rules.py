"""Question taxonomies: ordered rules, the first match wins. A rule list is a parameter everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Profile taxonomy (label, pattern), in rule order, with its fallback label.
PROFILE_RULES = [
    ("전화번호", r"전화번호|연락처|문의(?:처|번호)?|번호는 무엇"),
    ("가격·금액", r"가격|금액|얼마|원인가|요금|할인|결제"),
    ("수량·계수", r"몇\s*(?:개|명|마리|대|잔|장|곳|가지|층)|개수|수량|얼마나 많|총 몇"),
    ("날짜·시간", r"날짜|요일|시간|몇\s*시|기간|연도|년도|언제|영업시간"),
    ("색상", r"색(?:깔|상)?|무슨 빛|어떤 빛"),
    ("위치·방향", r"어디|위치|방향|왼쪽|오른쪽|위에|아래에|옆에|건너편|몇 층"),
    ("메뉴·상품", r"메뉴|상품|제품|음식|판매|주문|대표 메뉴|종류는"),
    ("인물·대상", r"누구|인물|사람|캐릭터|동물|무엇을 하고|어떤 사람"),
    ("문자·간판 읽기", r"적힌|쓰여|문구|상호명|간판|글자|텍스트|이름은|명칭|표시된"),
]
PROFILE_FALLBACK = "기타"

# Prompt taxonomy (label, substrings), in rule order.
PROMPT_RULES = [
    ("floor", ["층"]),
    ("phone", ["전화", "번호", "연락처"]),
    ("price", ["가격", "얼마", "원인", "원입니까", "원 인가"]),
    ("time", ["시간", "영업", "오픈", "마감", "시까지", "시부터", "휴무"]),
    ("count", ["몇 개", "몇개", "개수", "갯수", "총 몇"]),
    ("color", ["색"]),
    ("location", ["어디", "위치", "옆에", "왼쪽", "오른쪽", "위에", "아래에", "사이에"]),
    ("name", ["이름", "상호", "가게", "점포", "매장", "업체", "무엇이라고", "뭐라고", "적힌", "적혀", "쓰여", "써진", "쓰인"]),
]
PROMPT_FALLBACK = "other"

# Text-study taxonomy (label, pattern matched without case), in rule order.
TEXT_RULES = [
    ("phone", r"전화번호|연락처|휴대폰|핸드폰"),
    ("price", r"가격|얼마|금액|원인가|원입니까"),
    ("counting", r"몇\s*(개|명|마리|대|장|병|권)|개수|수량|몇인가|몇\s*인가"),
    ("color", r"무슨\s*색|어떤\s*색|색상|색깔"),
    ("spatial", r"어디|위치|왼쪽|오른쪽|위쪽|아래쪽|앞|뒤|옆"),
    ("ocr_text", r"적힌|써\s*있|쓰여|문구|글자|상호명|간판|메뉴판|표지판|이름은|명칭|브랜드"),
    ("action_state", r"무엇을\s*하고|뭐하고|행동|상태|하고\s*있|입고\s*있|들고\s*있"),
    ("object_category", r"무엇인가|무엇인가요|무엇입니까|종류|어떤\s*것|어떤\s*제품|어떤\s*메뉴"),
]
TEXT_FALLBACK = "other"

# Reading hint per prompt label.
PROMPT_HINTS = {
    "floor": "층 표시(1F, 2층, B1 등)를 먼저 찾고, 같은 층에 붙어 있는 간판의 글자만 읽으세요. 건물의 위아래 순서로 층을 세어 확인하세요.",
    "phone": "숫자를 한 자리씩 대조하세요. 지역번호, 하이픈 위치, 자릿수까지 정확히 비교하세요.",
    "price": "숫자와 단위(원, 천원, 만원)를 정확히 읽고 메뉴명과 짝이 맞는 가격인지 확인하세요.",
    "time": "숫자와 시/분, 오전/오후, 요일 표기를 정확히 읽으세요.",
    "count": "질문 조건에 맞는 대상만 세고 중복해서 세지 마세요.",
    "color": "질문 대상 글자나 간판 자체의 색만 보고 배경이나 조명은 무시하세요.",
    "location": "기준 대상을 먼저 찾고 그 주변 간판의 상대 위치를 확인하세요.",
    "name": "질문 조건(층, 위치, 업종)에 맞는 간판 하나를 특정한 뒤 그 간판의 글자를 보기와 한 글자씩 대조하세요.",
    "other": "질문 조건에 맞는 글자를 찾아 보기와 정확히 대조하세요.",
}

# Words ignored when counting question tokens.
STOP_WORDS = [
    "이", "그", "저", "있는", "사진", "속", "사진에서", "사진의",
    "무엇인가요", "무엇인가", "무엇입니까", "어떤", "것은", "있는가요",
]


def first_match(conditions: Sequence[tuple[str, Column]], fallback: str) -> Column:
    """Label of the first condition that holds."""
    out = None
    for label, cond in conditions:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(fallback) if out is None else out.otherwise(F.lit(fallback))


def pattern_label(text: Column, rules, fallback: str, ignore_case: bool = False) -> Column:
    flags = "(?iuU)" if ignore_case else "(?U)"
    return first_match([(label, text.rlike(flags + pattern)) for label, pattern in rules], fallback)


def substring_label(text: Column, rules, fallback: str) -> Column:
    conditions = []
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        conditions.append((label, hit))
    return first_match(conditions, fallback)


def profile_type(text: Column) -> Column:
    return pattern_label(text, PROFILE_RULES, PROFILE_FALLBACK)


def prompt_type(text: Column) -> Column:
    return substring_label(text, PROMPT_RULES, PROMPT_FALLBACK)


def text_type(text: Column) -> Column:
    return pattern_label(text, TEXT_RULES, TEXT_FALLBACK, ignore_case=True)


def hint_for(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PROMPT_HINTS.items() for x in pair])
    return F.element_at(table, label)
