"""They must match the exported data and the target services exactly."""

# Export layout.
METADATA_SUFFIX = " metadata.json"
HTML_SUFFIX = ".html"
CHILD_DIRS = ["Sources", "Notes", "Artifacts", "Discovered Sources"]

# Defaults.
UNTITLED_FILE = "Untitled"
UNTITLED_NOTEBOOK = "Untitled Notebook"
DEFAULT_EMOJI = "📓"
DEFAULT_ARTIFACT_TYPE = "STUDIO_ARTIFACT"
DEFAULT_OWNER_KEY = "default_user"
TYPE_UNKNOWN = "SOURCE_CONTENT_TYPE_UNKNOWN"
TYPE_URL = "SOURCE_CONTENT_TYPE_URL"
TYPE_NOTE = "NOTE"
VIDEO_URL_PREFIX = "https://www.youtube.com/watch?v="
SITE_URL_PREFIX = "https://contoso.sharepoint.com/sites/GeminiNotebooks/Shared Documents/"

# File names.
FORBIDDEN_FILE_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
MAX_FILE_NAME = 180
ARCHIVE_AFFIXES = r"^takeout-|\.zip$"
EMAIL_PATTERN = r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"

# Identity map: accepted headers, in order of preference.
IDENTITY_ALIASES = {
    "gws_email": ["gws_email", "gws_source_email", "source_email", "email"],
    "m365_upn": ["m365_upn", "m365_sharepoint_upn", "target_upn"],
    "ge_target_email": ["ge_target_email", "gemini_enterprise_target_email"],
    "sharepoint_site_url": [
        "sharepoint_site_url",
        "sharepoint_onedrive_destination_url",
    ],
}

# Link scoring.
TITLE_STOP_WORDS = [
    "the", "and", "for", "with", "from", "how", "what", "why",
    "com", "org", "net", "wikipedia",
]
BLOCKED_HOSTS = [
    "onelink.me", "sng.link", "twitter.com", "facebook.com", "linkedin.com",
    "t.co", "accounts.google",
]
BLOCKED_PATHS = [
    "/login", "/signup", "/cart", "/customer_authentication", "/special:",
    "/wikipedia:", "/portal:", "/main_page", "/help:", "/talk:",
]
BLOCKED_QUERIES = ["action=edit", "printable=yes"]
TRACKING_QUERIES = ["utm_", "locale="]
CONTENT_FRAGMENTS = [
    "bodycontent", "maincontent", "content", "main", "overview",
    "course-outline", "top",
]
HOME_PATHS = ["", "/", "/en", "/courses", "/blog"]
WIKI_HOST_PATH = "wikipedia.org/wiki/"
WIKI_TITLE_SUFFIX = " - Wikipedia"

# HTML blocks.
HEADING_TAGS = ["h1", "h2", "h3", "h4"]
BLOCK_TAGS = HEADING_TAGS + ["p", "li", "pre", "blockquote"]

# Staging layout.
TRANSFER_LIBRARY = "Documents"
TRANSFER_ROOT = "NotebookLM_Migrated"
INDEX_FILE = "Notebook_Sources_Index.md"
INDEX_OWNER = "- **GWS Owner**: `"
INDEX_LIBRARY_OWNER = "- **Target M365 / SharePoint Owner**: `"
INDEX_TARGET_USER = "- **Target Gemini Enterprise User**: `"
INDEX_TOTAL = "- **Total Sources**: "
INDEX_SECTION = "## Sources Inventory & Original URLs"
INDEX_HEADER = "| # | Source Title | Original Type | Original URL / Origin | SharePoint File |"
INDEX_RULE = "|---|---|---|---|---|"
INDEX_NO_URL = "_Uploaded File_"
TRANSFER_FILE = "sharepoint_spmt_manifest.csv"
SCRIPT_FILE = "upload_to_sharepoint_pnp.ps1"
TRANSFER_COLUMNS = [
    "SourcePath", "TargetDocumentLibrary", "TargetSubFolder", "TargetWebUrl",
    "GWS_Owner_Email", "M365_SharePoint_UPN", "GE_Target_Email",
]

# Provisioning.
SERVICE_HOST = "discoveryengine.googleapis.com"
RETRYABLE_STATUS = [429, 500, 502, 503, 504]
OK_STATUS = [200, 201]
MAX_ATTEMPTS = 4
METHOD_VIDEO = "batchCreate (youtubeContent)"
METHOD_WEB = "batchCreate (webContent)"
METHOD_FILE = "uploadFile (.docx)"
SHARE_ROLE = "PROJECT_ROLE_WRITER"

# Upload.
DRIVE_URL_PREFIX = "https://graph.microsoft.com/v1.0/drives/"

# Labels.
SOURCE_TYPE_LABELS = {
    "SOURCE_CONTENT_TYPE_URL": "🌐 Website URL",
    "SOURCE_CONTENT_TYPE_YOUTUBE_VIDEO": "▶️ YouTube Video",
    "SOURCE_CONTENT_TYPE_PDF": "📕 PDF Document",
    "SOURCE_CONTENT_TYPE_POWERPOINT": "📊 PowerPoint",
}
LABEL_OTHER = "📄 "
LABEL_URL = "🔗 "
LABEL_CHANNEL = " 📺 "
LABEL_NO_URL = "📁 Uploaded File Snapshot (Converted to .docx)"
PREVIEW_LIMIT = 60

# Word document header lines, styles (size in half points, colour) and parts.
DOCX_TYPE = "Original Source Type: "
DOCX_OWNER = " | Owner: "
DOCX_ADDED = " | Added: "
DOCX_UNKNOWN = "N/A"
DOCX_URL = "Original Source URL: "
DOCX_CHANNEL = "YouTube Channel: "
DOCX_BULLET = "• "
STYLE_TITLE = (36, "1A73E8", True)
STYLE_ABOUT = (18, "5F6368", False)
STYLE_URL = (20, "1A73E8", True)
STYLE_TEXT = (22, "202124", False)
HEADING_SIZES = {1: 32, 2: 28}
HEADING_SIZE_OTHER = 24
HEADING_COLOR = "174EA6"
# The parts of a document: their elements are fixed by the format, white space between them is not,
# so there is none.
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
DOCX_CONTENT_TYPES = (
    f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
DOCX_RELS = (
    f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="word/document.xml" Type='
    '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"/></Relationships>'
)
DOCX_BODY_OPEN = (
    f'{_XML}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
)
DOCX_BODY_CLOSE = (
    '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/>'
    '<w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr>'
    "</w:body></w:document>"
)
