"""Fixed values that decide results: rule words, labels and output texts.

Order matters everywhere: the first label whose keyword occurs wins.
"""

# --- Fixed values: department keywords, whole text ---------------------------
DEPARTMENT_RULES = [
    ("Training Department", ["đào tạo", "giảng dạy", "giáo trình", "học tập", "sinh viên"]),
    ("Academic Affairs", ["học vụ", "đăng ký", "tín chỉ", "kết quả học tập"]),
    ("Student Affairs", ["sinh viên", "học sinh", "quản lý sinh viên"]),
    ("Finance", ["tài chính", "học phí", "ngân sách"]),
    ("Administration", ["hành chính", "quản lý", "tổ chức"]),
]
DEFAULT_DEPARTMENT = "Training Department"

# --- Fixed values: block category keywords -----------------------------------
CONTENT_CATEGORY_RULES = [
    ("postgraduate_training", ["tiến sĩ", "thạc sĩ", "sau đại học", "ts", "ths"]),
    ("admissions", ["tuyển sinh", "xét tuyển", "điều kiện dự tuyển"]),
    ("finance_and_tuition", ["học phí", "miễn giảm", "thu", "chi", "quy định phí"]),
    ("examination", ["kỳ thi", "thi cử", "đánh giá", "kiểm tra"]),
    ("internship", ["thực tập", "tttn", "doanh nghiệp", "internship"]),
    ("distance_learning", ["đào tạo từ xa", "e-learning", "online", "qua mạng"]),
    ("student_affairs", ["công tác sinh viên", "khen thưởng", "kỷ luật", "học bổng", "rèn luyện"]),
    ("human_resources", ["tổ chức cán bộ", "nhân sự", "cbvc"]),
    ("academic_affairs", ["phòng đào tạo", "chương trình học", "tín chỉ", "kế hoạch giảng dạy",
                          "gdtc", "thể chất", "quy chế"]),
]

# --- Fixed values: file-name category keywords -------------------------------
FILENAME_CATEGORY_RULES = [
    ("admissions", ["tuyển sinh", "xét tuyển", "dự tuyển"]),
    ("postgraduate_training", ["thạc sĩ", "tiến sĩ", "sau đại học", "thạc sỹ", "tiến sỹ"]),
    ("academic_affairs", ["đào tạo", "tín chỉ", "ctđt", "gdtc", "giảng dạy", "học tập",
                          "giáo trình", "chuẩn đầu ra", "tin học", "ngoại ngữ",
                          "chương trình", "khung chương trình"]),
    ("internship", ["thực tập", "tttn", "đồ án", "khóa luận", "khoá luận"]),
    ("distance_learning", ["đào tạo từ xa", "e-learning", "trực tuyến", "online"]),
    ("finance_and_tuition", ["học phí", "tài chính", "miễn", "giảm", "phí"]),
    ("examination", ["thi cử", "kiểm tra", "đánh giá", "kỳ thi", "kết quả học tập"]),
    ("human_resources", ["cán bộ", "giảng viên", "cbvc", "nhân sự", "tuyển dụng"]),
    ("student_affairs", ["công tác sinh viên", "ngoại khóa", "hoạt động", "học bổng",
                         "khen thưởng", "kỷ luật"]),
    ("training_and_regulations", ["quy chế", "quy định", "nội quy", "quy tắc"]),
]
DEFAULT_CATEGORY = "training_and_regulations"

# --- Fixed values: file handling ---------------------------------------------
ACCEPTED_EXTENSIONS = [".pdf", ".txt", ".docx", ".doc", ".md", ".markdown"]
TEXT_EXTENSIONS = [".txt", ".md", ".markdown"]
FILENAME_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".txt", ".md"]
MAX_FILE_BYTES = 16 * 1024 * 1024
FORBIDDEN_NAME_CHARS = r'[/\\:*?"<>|]'
STORED_NAME_TIME_FORMAT = "yyyyMMdd_HHmmss"

# --- Fixed values: request handling ------------------------------------------
EXTRACT_INTENT_WORDS = ["trích xuất", "extract", "markdown", "md"]
ANSWER_PREFIX = "Đã nhận câu hỏi: '"
ANSWER_MIDDLE = "'\n\nNội dung PDF đã được trích xuất sang Markdown:\n\n"
PREVIEW_CHARS = 500
MIN_TEXT_CHARS = 50

# --- Fixed values: extraction limits -----------------------------------------
NUMBER_LINE_CHARS = 2000
CLAUSE_SPLIT_MIN_CHARS = 600
KEYWORD_WORDS = 5
TITLE_SKIP_PREFIXES = ["Căn cứ", "Theo", "QUYẾT ĐỊNH", "Điều", "Khoản", "Chương"]

# --- Fixed values: labels and output texts -----------------------------------
SOURCE_BASIS = "Căn cứ"
SOURCE_DECISION = "Quyết định"
SOURCE_ARTICLE = "Điều"
SOURCE_CLAUSE = "Khoản"
SOURCE_POINT = "Điểm"
SOURCE_APPENDIX = "Phụ lục"
SOURCE_UNKNOWN = "Unknown"
TYPE_DATA = "markdown"
BASIS_TITLE = "Các căn cứ pháp lý để ban hành quy định"
DECISION_TITLE = "QUYẾT ĐỊNH ban hành các quy định liên quan đến "
DECISION_BLOCK_TITLE = "Quyết định ban hành quy định"
DEFAULT_TITLE = "Quy định"
KEYWORD_LINK = " liên quan đến "
METADATA_HEADING = "## Metadata"
CONTENT_HEADING = "## Nội dung"
METADATA_FIELDS = ["doc_id", "department", "type_data", "category", "date", "source"]
PAGE_HEADING = "## Trang "
