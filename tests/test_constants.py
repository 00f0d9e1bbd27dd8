"""Values that exported data and target services prescribe, pinned once as literals.

The SQL twins take them from the same module as the code, so they cannot see a wrong list.
"""

from codexferry import constants as C


def test_layout_and_names():
    assert C.CHILD_DIRS == ["Sources", "Notes", "Artifacts", "Discovered Sources"]
    assert (C.METADATA_SUFFIX, C.HTML_SUFFIX) == (" metadata.json", ".html")
    assert (C.UNTITLED_FILE, C.UNTITLED_NOTEBOOK, C.MAX_FILE_NAME) == ("Untitled", "Untitled Notebook", 180)
    assert C.TRANSFER_COLUMNS == [
        "SourcePath", "TargetDocumentLibrary", "TargetSubFolder", "TargetWebUrl",
        "GWS_Owner_Email", "M365_SharePoint_UPN", "GE_Target_Email",
    ]
    assert (C.TRANSFER_FILE, C.SCRIPT_FILE, C.INDEX_FILE) == (
        "sharepoint_spmt_manifest.csv", "upload_to_sharepoint_pnp.ps1", "Notebook_Sources_Index.md",
    )


def test_identity_headers():
    assert C.IDENTITY_ALIASES == {
        "gws_email": ["gws_email", "gws_source_email", "source_email", "email"],
        "m365_upn": ["m365_upn", "m365_sharepoint_upn", "target_upn"],
        "ge_target_email": ["ge_target_email", "gemini_enterprise_target_email"],
        "sharepoint_site_url": ["sharepoint_site_url", "sharepoint_onedrive_destination_url"],
    }


def test_link_rules():
    assert C.TITLE_STOP_WORDS == [
        "the", "and", "for", "with", "from", "how", "what", "why", "com", "org", "net", "wikipedia",
    ]
    assert C.BLOCKED_HOSTS == [
        "onelink.me", "sng.link", "twitter.com", "facebook.com", "linkedin.com", "t.co", "accounts.google",
    ]
    assert C.BLOCKED_PATHS == [
        "/login", "/signup", "/cart", "/customer_authentication", "/special:", "/wikipedia:",
        "/portal:", "/main_page", "/help:", "/talk:",
    ]
    assert C.BLOCKED_QUERIES + C.TRACKING_QUERIES == ["action=edit", "printable=yes", "utm_", "locale="]
    assert C.CONTENT_FRAGMENTS == [
        "bodycontent", "maincontent", "content", "main", "overview", "course-outline", "top",
    ]
    assert C.HOME_PATHS == ["", "/", "/en", "/courses", "/blog"]


def test_blocks_and_requests():
    assert C.BLOCK_TAGS == ["h1", "h2", "h3", "h4", "p", "li", "pre", "blockquote"]
    assert C.RETRYABLE_STATUS == [429, 500, 502, 503, 504] and C.OK_STATUS == [200, 201]
    assert (C.MAX_ATTEMPTS, C.SHARE_ROLE, C.PREVIEW_LIMIT) == (4, "PROJECT_ROLE_WRITER", 60)
