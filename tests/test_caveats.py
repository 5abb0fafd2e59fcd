"""Claims against their sources, case by case."""

from pyspark.sql import functions as F

from deskloom.functions import caveats

ADVISORY = """The backup driver permits a local user to write to physical disks.
When Secure Boot is disabled, this can allow execution of arbitrary UEFI-level code before the operating system starts.
The advisory does not establish exploitation in the wild or identify a fixed version.
Version 8.4.0 is affected. The vendor recommends updating to a corrected driver when available."""
SUPPORTED = "Version 8.4.0 is vulnerable. Version 8.4.1 fixes the bug. The vendor recommends users update to version 8.4.1."
NO_PATCH = "No official patch is available. The vendor is investigating the issue."
BY_DEFAULT = "The feature is on by default for organizations with Gemini enabled. There is no end-user setting. Users can download the Windows app."
BOOT, ATTACKS, FIX, VERSION, SCOPE, INSTALL = (
    "CAVEAT_SECURE_BOOT_REQUIRED", "CAVEAT_EXPLOITATION_UNKNOWN", "CAVEAT_FIX_UNAVAILABLE", "CAVEAT_FIX_VERSION_UNSUPPORTED",
    "CAVEAT_DEFAULT_ENABLEMENT_SCOPE", "CAVEAT_INSTALLATION_REQUIRED",
)

#: (source, lost codes, claims that lose them)
CASES = [
    (ADVISORY, [BOOT], [
        "The issue allows attackers to execute arbitrary UEFI-level code by writing to disk devices.", "The driver enables code execution before the OS starts.",
        "UEFI-level code execution can bypass protections.", "Attackers could execute arbitrary code before the operating system starts.", "The issue allows code execution at the UEFI level.",
        "Secure Boot is disabled. The bug allows UEFI code execution.", "Secure Boot is disabled on another system, and the bug allows UEFI code execution.",
        "When Secure Boot is disabled on another system, the bug allows UEFI code execution.", "With Secure Boot disabled, disk writes are possible. The bug permits UEFI code execution.",
        "With Secure Boot disabled, UEFI code execution is possible, but UEFI code execution also works without that prerequisite.",
        "UEFI code execution does not require Secure Boot to be disabled.", "UEFI code execution doesn’t require Secure Boot to be disabled.", "UEFI code execution works with Secure Boot disabled or enabled.",
    ]),
    (ADVISORY, [], [
        "With Secure Boot off, the disk writes could enable UEFI code execution.", "Without Secure Boot, attackers could execute code before the OS starts.",
        "UEFI-level code execution requires Secure Boot to be disabled.", "Secure Boot must be disabled for UEFI code execution to be possible.", "The disk writes may corrupt stored data.",
        "The advisory does not establish that the driver enables UEFI code execution.", "There is no evidence that the bug is actively exploited.", "Exploitation in the wild remains unconfirmed.",
        "The source has not confirmed exploitation in the wild.", "Watch for reports of exploitation in the wild.", "The bug could be exploited in the wild.",
        "The vulnerable product is version 8.4.0. A fixed version was not identified.", "The vendor recommends checking for a patch.", "", None,
    ]),
    (ADVISORY, [ATTACKS], [
        "Attackers are exploiting the flaw in the wild.", "The bug is actively exploited.", "Attackers are currently exploiting the bug.", "Threat actors have exploited the vulnerability.",
        "The driver was used in attacks.", "Exploitation has been confirmed.", "There is no evidence of attacks, but the flaw is actively exploited.",
    ]),
    (ADVISORY, [VERSION], ["The issue is fixed in version 8.4.0.", "Version 8.4.0 fixes the bug.", "Update to version 8.4.0.", "Update the backup software to version 8.4.0.", "The fixed release is 8.4.1."]),
    (ADVISORY, [BOOT, ATTACKS, VERSION], ["The issue allows UEFI code execution. The flaw is actively exploited. Version 8.4.0 fixes it."]),
    ("The issue allows UEFI code execution.", [], ["The issue allows UEFI code execution."]),
    ("Without Secure Boot, this permits UEFI code execution.", [BOOT], ["The issue allows UEFI code execution."]),
    ("The exploit requires Secure Boot to be disabled. It permits execution of arbitrary UEFI-level code before the operating system starts.", [BOOT], ["The flaw permits UEFI code execution."]),
    ("The flaw permits UEFI code execution. This requires Secure Boot to be disabled.", [BOOT], ["The flaw permits UEFI code execution."]),
    ("This requires Secure Boot to be disabled. An unrelated platform implements UEFI code execution.", [], ["The flaw permits UEFI code execution."]),
    (SUPPORTED, [], ["The bug is fixed in version 8.4.1.", "Update to version 8.4.1.", "Version 8.4.1 fixes the issue.", "The issue is not fixed in version 8.4.0."]),
    (SUPPORTED, [VERSION], ["Watch for a fix in version 8.4.0."]),
    ("The issue might be fixed in version 8.4.1.", [VERSION], ["The issue is fixed in version 8.4.1."]),
    (NO_PATCH, [FIX], ["A patch is now available.", "The vendor released a fix.", "The vendor has fixed the issue."]),
    (NO_PATCH, [], ["Watch for a patch to be released.", "No patch is available.", "A patch has not been released."]),
    ("No patch was available at disclosure. The vendor released a patch today.", [], ["The vendor released a patch."]),
    ("No exploitation was known at disclosure. Attacks have now been confirmed.", [], ["Exploitation has been confirmed."]),
    ("The vendor released a patch previously. No patch is available for this issue.", [FIX], ["A patch is available."]),
    (BY_DEFAULT, [SCOPE], [
        "The Gemini app is on by default for all Workspace users.", "Organizations with Gemini enabled can use the app. It is enabled by default for everyone.",
        "For organizations with Gemini enabled, the app is on by default for personal Google accounts too.", "For other organizations with Gemini enabled, setup differs, and this app is enabled by default.",
        "For organizations with another service enabled, Gemini is enabled by default.",
    ]),
    (BY_DEFAULT, [], [
        "For organizations with Gemini enabled, the feature is on by default. Users can download the Windows app.", "The app is enabled by default for organizations that already have Gemini enabled.",
        "In organizations where Gemini is already enabled, the feature is on by default.", "The source does not say Gemini is enabled by default for all accounts.",
        "Check whether the app is enabled by default for your organization.", "Download the app before trying the shortcut.", "The publisher does not say the app is preinstalled.",
        "Check whether the app is already installed on your device.", "The app has no end-user setting for this feature.",
    ]),
    (BY_DEFAULT, [INSTALL], ["The Gemini app is preinstalled for users.", "The app is automatically installed for everyone.", "The app needs no installation.", "Use the app without downloading it.", "No download is required to use the app."]),
    ("The app is enabled by default for all users.", [], ["The app is enabled by default."]),
    (None, [], ["Text", None]),
]


def test_lost_caveats(spark):
    cases = [(claim, source, codes) for source, codes, claims in CASES for claim in claims]
    df = spark.createDataFrame([(i, c, s) for i, (c, s, _) in enumerate(cases)], "i int, claim string, source string")
    got = {r["i"]: r["codes"] for r in df.select("i", caveats.lost_caveats(F.col("claim"), F.col("source")).alias("codes")).collect()}
    assert [(c, s, got[i]) for i, (c, s, _) in enumerate(cases)] == cases


def test_occurrences(spark):
    row = spark.createDataFrame([("a1b22c",)], "t string").select(caveats.occurrences(F.col("t"), r"[a-z](\d+)", 1).alias("o")).first()
    assert [tuple(x) for x in row["o"]] == [("", "1", "b22c"), ("a1", "22", "c")]
