"""Word lists, tables and thresholds which results depend on."""

# Layer-name prefixes in test order and the role each stands for.
LAYER_PREFIXES = [
    ("title-group", "title-group"), ("product-group", "product-group"), ("title", "title"), ("body", "body"),
    ("badge", "badge"), ("product", "product"), ("person", "person"), ("logo", "logo"), ("bg", "bg"),
]
BACKGROUND_PIXEL_NAMES = ["배경", "background"]
BACKGROUND_NAMES = ["bg", "배경", "background"]

# Placement anchors by scene role, in the order they are tried; other roles use the default.
ROLE_ANCHORS = {
    "title_group": ["top-left", "top-center", "top-right", "bottom-left", "bottom-center", "bottom-right"],
    "product": ["left-center", "right-center", "center-left", "center-right", "top-left", "top-right"],
    "logo": ["top-left", "top-right"],
    "cta_group": ["bottom-left", "bottom-center", "bottom-right"],
    "body_text_group": ["top-left", "top-center", "top-right"],
    "badge": ["top-left", "top-right"],
    "decorative_ad": ["left-center", "right-center"],
}
DEFAULT_ANCHORS = ["top-center"]
SCALES = [1.0, 0.9, 0.8, 0.7, 0.6]
PRODUCT_MIN_SHARE = 0.25
ROLE_PRIORITY = {"product": 0, "title_group": 1, "logo": 2, "cta_group": 3, "badge": 4, "body_text_group": 5,
                 "decorative_ad": 6}
LAST_PRIORITY = 99
MAX_OVERLAP = 0.30
MAX_PROTECTED_COVER = 0.30

# Well-known aspect ratios in tie-break order.
KNOWN_RATIOS = [(16, 9), (4, 3), (1, 1), (9, 16), (3, 4), (2, 1), (3, 2), (21, 9), (1, 2), (1, 3), (3, 1)]
RATIO_TYPES = ["square", "vertical", "horizontal"]

# Catalog fields whose change makes an upsert UPDATED; all others are ignored by the comparison.
COMPARED_SPEC_FIELDS = [
    "media", "width", "height", "placement_name", "placement_type", "category", "parse_status", "safe_top",
    "safe_right", "safe_bottom", "safe_left", "max_file_size_kb", "min_file_size_kb", "needs_review", "is_video",
    "notes", "last_verified", "last_updated",
]

# Default placements, fixed values: media, name, slug, width, height, ratio, sort order.
DEFAULT_SPECS = [
    ("google", "GDN 스카이스크래퍼", "gdn_skyscraper_sm", 120, 600, "1:5", 1),
    ("google", "GDN 와이드 스카이스크래퍼", "gdn_wide_skyscraper", 160, 600, "4:15", 2),
    ("google", "GDN 소형 정사각형", "gdn_small_square", 200, 200, "1:1", 3),
    ("google", "GDN 세로형", "gdn_vertical_rectangle", 240, 400, "3:5", 4),
    ("google", "GDN 정사각형", "gdn_square", 250, 250, "1:1", 5),
    ("google", "GDN 트리플 와이드스크린", "gdn_triple_widescreen", 250, 360, "25:36", 6),
    ("google", "GDN 모바일 배너 소형", "gdn_mobile_banner_sm", 300, 50, "6:1", 7),
    ("google", "GDN 중간 직사각형", "gdn_medium_rectangle", 300, 250, "6:5", 8),
    ("google", "GDN 하프 페이지", "gdn_half_page", 300, 600, "1:2", 9),
    ("google", "GDN 세로형 대형", "gdn_portrait_large", 300, 1050, "2:7", 10),
    ("google", "GDN 모바일 리더보드", "gdn_mobile_leaderboard", 320, 50, "32:5", 11),
    ("google", "GDN 모바일 대형 배너", "gdn_mobile_large_banner", 320, 100, "16:5", 12),
    ("google", "GDN 대형 직사각형", "gdn_large_rectangle", 336, 280, "6:5", 13),
    ("google", "GDN 배너", "gdn_banner", 468, 60, "39:5", 14),
    ("google", "GDN 넷보드", "gdn_netboard", 580, 400, "29:20", 15),
    ("google", "GDN 리더보드", "gdn_leaderboard", 728, 90, "728:90", 16),
    ("google", "GDN 상단 배너", "gdn_top_banner", 930, 180, "31:6", 17),
    ("google", "GDN 세로형 와이드", "gdn_portrait_wide", 960, 1200, "4:5", 18),
    ("google", "GDN 빌보드", "gdn_billboard", 970, 250, "97:25", 19),
    ("google", "GDN 파노라마", "gdn_panorama", 980, 120, "49:6", 20),
    ("google", "GDN 세로형 XL", "gdn_portrait_xl", 900, 1600, "9:16", 21),
    ("google", "GDN 반응형 가로형", "gdn_responsive_landscape", 1200, 628, "1.91:1", 22),
    ("google", "GDN 반응형 정사각형", "gdn_responsive_square", 1200, 1200, "1:1", 23),
    ("meta", "피드 1:1", "feed_square", 1080, 1080, "1:1", 201),
    ("meta", "피드 4:5", "feed_portrait", 1080, 1350, "4:5", 202),
    ("meta", "스토리/릴스 9:16", "story_reels", 1080, 1920, "9:16", 203),
    ("meta", "카탈로그 정사각형", "catalog_square", 1200, 1200, "1:1", 204),
    ("meta", "인스타그램 릴스", "instagram_reels", 1440, 2560, "9:16", 205),
    ("criteo", "스카이스크래퍼", "skyscraper_sm", 120, 600, "1:5", 301),
    ("criteo", "와이드 스카이스크래퍼", "wide_skyscraper", 160, 600, "4:15", 302),
    ("criteo", "소형 정사각형", "small_square", 200, 200, "1:1", 303),
    ("criteo", "소형 정사각형 2", "small_square_md", 240, 240, "1:1", 304),
    ("criteo", "정사각형", "square", 250, 250, "1:1", 305),
    ("criteo", "직사각형 소형", "rectangle_sm", 280, 230, "28:23", 306),
    ("criteo", "중간 직사각형", "medium_rectangle", 300, 250, "6:5", 307),
    ("criteo", "하프 페이지", "half_page", 300, 600, "1:2", 308),
    ("criteo", "모바일 대형 배너", "mobile_large_banner", 320, 100, "16:5", 309),
    ("criteo", "모바일 리더보드", "mobile_leaderboard", 320, 50, "32:5", 310),
    ("criteo", "대형 직사각형", "large_rectangle", 336, 280, "6:5", 311),
    ("criteo", "배너", "banner", 468, 60, "39:5", 312),
    ("criteo", "리더보드", "leaderboard", 728, 90, "728:90", 313),
    ("criteo", "빌보드", "billboard", 970, 250, "97:25", 314),
    ("criteo", "대형 가로형", "large_landscape", 1200, 600, "2:1", 315),
    ("mobion", "일반형 스카이스크래퍼", "general_skyscraper_sm", 120, 600, "1:5", 401),
    ("mobion", "일반형 와이드 스카이스크래퍼", "general_wide_skyscraper", 160, 600, "4:15", 402),
    ("mobion", "일반형 정사각형", "general_square", 250, 250, "1:1", 403),
    ("mobion", "일반형 배너 소형", "general_banner_sm", 300, 150, "2:1", 404),
    ("mobion", "일반형 직사각형", "general_rectangle", 336, 280, "6:5", 405),
    ("mobion", "일반형 모바일", "general_mobile", 720, 1230, "12:21", 406),
    ("mobion", "일반형 모바일 대형", "general_mobile_lg", 800, 1500, "8:15", 407),
    ("mobion", "일반형 빌보드", "general_billboard", 970, 250, "97:25", 408),
    ("mobion", "단색배경 직사각형", "solid_rectangle_sm", 300, 180, "5:3", 409),
    ("mobion", "단색배경 배너", "solid_banner", 320, 100, "16:5", 410),
    ("mobion", "단색배경 가로형", "solid_landscape", 720, 120, "6:1", 411),
    ("mobion", "단색배경 대형 가로", "solid_landscape_lg", 1456, 180, "364:45", 412),
    ("kakao", "비즈보드 가로형", "bizboard_horizontal", 1200, 628, "1.91:1", 501),
    ("kakao", "모먼트 정사각형", "moment_square", 1080, 1080, "1:1", 502),
    ("kakao", "모먼트 세로형", "moment_portrait", 1080, 1350, "4:5", 503),
    ("kakao", "모먼트 스토리", "moment_story", 1080, 1920, "9:16", 504),
    ("kakao", "모바일 배너", "mobile_banner", 320, 50, "32:5", 505),
    ("linkedin", "가로형", "landscape", 1200, 628, "1.91:1", 601),
    ("linkedin", "정사각형", "square", 1080, 1080, "1:1", 602),
    ("linkedin", "세로형", "portrait", 1080, 1350, "4:5", 603),
    ("tiktok", "인피드 광고", "infeed", 1080, 1920, "9:16", 701),
]

VALID_VERSIONS = ["clean_v1"]
RESULT_SOURCE = "clean_pipeline"

# --- model answers -----------------------------------------------------------------------------------------------
RESIZE_MODES = ["smart-fit", "cover", "contain", "blur-bg"]
STRENGTHS = ["safe", "balanced", "fill"]
FOCAL_POSITIONS = ["center", "top", "bottom", "left", "right", "left-top", "right-top", "left-bottom", "right-bottom"]
CREATIVE_TYPES = ["text_heavy", "product_focused", "balanced_mix", "poster_info"]
LAYOUT_TYPES = ["single_subject", "product_visual", "poster_info", "horizontal_bands", "vertical_bands", "mixed_layout"]
BAND_ROLES = ["main_title", "date_info", "description", "product_visual", "sub_copy", "cta", "logo", "decoration",
              "headline", "date_cta", "subcopy", "background", "visual"]
REFLOW_PRIORITIES = ["hero", "support", "optional"]
TARGET_PLACEMENTS = ["top", "center", "bottom", "left", "right"]
DENSITIES = ["high", "medium", "low"]
ELEMENT_TYPES = ["product", "person", "text", "logo", "cta", "price", "discount", "badge", "decoration", "background"]
IMPORTANCES = ["required", "priority", "optional"]
GROUPS = ["main_product", "main_copy", "sub_copy", "price_discount", "cta", "logo", "decorations", "background"]
GROUP_LABELS = {"main_product": "메인 제품", "main_copy": "메인 카피", "sub_copy": "서브 카피", "price_discount": "가격/할인",
                "cta": "CTA", "logo": "로고", "decorations": "장식", "background": "배경"}

OBJECT_ROLES = ["background", "title", "body_text", "main_image", "cta", "logo", "badge", "decoration", "unknown"]
REFLOW_BEHAVIORS = ["fill_canvas", "keep_aspect", "move_only", "optional_drop"]
REQUIRED_OBJECT_ROLES = ["background", "title", "main_image"]
MATCHED_STATUSES = ["ready", "matched_low_confidence"]
ROLE_SYNONYMS = {
    "main_image": ["visual", "visual_element", "product", "product_image", "image", "key_visual", "keyvisual", "hero"],
    "title": ["headline", "header", "main_copy"],
    "body_text": ["sub_text", "body", "copy", "description"],
    "cta": ["btn", "button"],
    "logo": ["brand"],
}
ANALYSIS_VERSION = "psd-object-map-v2"

# Detector category to scene role and required flag, per dialect; z-order by role for the strict dialect.
SCENE_ROLES = {
    "product": ("product", True), "sub_product": ("product", False), "title_group": ("title_group", True),
    "person_zone": ("protected_subject", False), "protected_subject": ("protected_subject", False),
    "decorative_panel": ("decorative_ad", False),
}
CATEGORY_ROLES = {
    "main_product": ("product", True), "brand_logo": ("logo", False), "advertising_text": ("title_group", True),
    "person_zone": ("protected_subject", False), "decorative_panel": ("decorative_ad", False),
}
SCENE_Z = {"product": 0, "protected_subject": 0, "decorative_ad": 0, "logo": 5, "title_group": 10}

VISIBLE_EXCLUDED = ["decoration", "unknown"]
OBJECT_CATEGORIES = {"image": ["main_image"], "text": ["title", "body_text"], "logo_cta": ["logo", "cta", "badge"],
                     "person": ["person"], "bg_deco": ["background", "decoration"]}
DATE_LABELS = ["날짜", "기간", "신청"]
DATE_GROUPS = ["date", "period", "info"]
COMPARE_CANDIDATES = ["safe", "balanced", "fill", "focus-fill", "poster-reflow", "center-crop", "letterbox", "object-aware-fit"]

DEFAULT_PROMPTS = {
    "product": ["cosmetic product", "product tube", "cosmetic tube", "product bottle", "cosmetic bottle", "product package",
                "cream jar", "skincare product", "makeup product"],
    "person": ["person", "woman", "man", "model"],
    "hand": ["hand", "hands"],
    "logo": ["brand logo", "logo"],
    "cta": ["button", "call to action button"],
}
EXPERIMENTAL_PROMPTS = ["cta"]
NATIVE_MASK_BASE = {"psd_isolated_layer": 95.0, "psd_alpha": 80.0, "psd_layer_mask": 82.0, "ai_bbox_crop": 60.0,
                    "object_bbox_coarse": 40.0, "bbox_coarse": 35.0, "visual_context": 20.0, "composite_fallback": 10.0,
                    "unknown": 5.0}
