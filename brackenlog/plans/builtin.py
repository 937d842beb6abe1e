"""Log schemas and saved searches every session starts with."""

from __future__ import annotations

from brackenlog.plans.schema import LogSchema, Sample

# ---- Fixed values: names, templates, patterns and time formats of the known log formats.

BRACKETED = LogSchema(
    name="Bracketed default",
    template=(
        "<timestamp> [HOST:<host>][SERVER:<server>][PID:<process_id>][THR:<thread_id>]"
        "[<log_module>][<log_level>][<error_code?>][UID:<user_id>][SID:<session_id>]"
        "[OID:<object_id>][<file_name>:<line_number>] <message>"
    ),
    description="Server log with bracketed fields",
    samples=(
        Sample(
            "2024-03-01 08:00:00.125 [HOST:a1][SERVER:Web][PID:7][THR:901][Router][Info][UID:0]"
            "[SID:0][OID:0][Router.cpp:12] listening",
            "Info",
        ),
        Sample(
            "2024-03-01 08:00:01.250 [HOST:a1][SERVER:Web][PID:7][THR:901][Store][Error][0x80040001]"
            "[UID:A1][SID:B2][OID:C3][Store.cpp:77] row is locked",
            "Error",
        ),
    ),
)

GENERIC = LogSchema(name="Generic line", template="<message>", description="One entry per line")

SPRING_BOOT = LogSchema(
    name="Spring Boot",
    template="<timestamp> <levelpad><level> <pid> --- [<threadpad><thread>] <module><modulepad> : <message>",
    time_format="%Y-%m-%d %H:%M:%S%.3f",
    field_patterns={
        "timestamp": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}",
        "levelpad": " *",
        "level": "[A-Z]+",
        "pid": r"\d+",
        "threadpad": " *",
        "thread": r"[^\]]*",
        "module": r"\S+",
        "modulepad": " *",
    },
    entry_start=r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    samples=(
        Sample("2024-03-01 08:00:00.125  WARN 41 --- [           main] a.b.Shop       : low stock", "WARN"),
    ),
)

SPRING_BOOT_3 = LogSchema(
    name="Spring Boot 3",
    template=(
        "<timestamp><zone> <levelpad><level> <pid> --- [<threadpad><thread>] "
        "<module><modulepad> : <message>"
    ),
    time_format="%Y-%m-%dT%H:%M:%S%.3f",
    field_patterns={
        "timestamp": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}",
        "zone": r"(?:Z|[+-]\d{2}:\d{2})?",
        "levelpad": " *",
        "level": "[A-Z]+",
        "pid": r"\d+",
        "threadpad": " *",
        "thread": r"[^\]]*",
        "module": r"\S+",
        "modulepad": " *",
    },
    entry_start=r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    samples=(
        Sample("2024-03-01T08:00:00.125+01:00 ERROR 41 --- [    worker-3] a.b.Shop : no stock", "ERROR"),
    ),
)

TOMCAT_CATALINA = LogSchema(
    name="Tomcat Catalina",
    template="<timestamp> <level> [<thread>] <module> <message>",
    time_format="%d-%b-%Y %H:%M:%S%.3f",
    field_patterns={
        "timestamp": r"\d{2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2}:\d{2}\.\d{3}",
        "level": "[A-Z]+",
        "thread": r"[^\]]*",
        "module": r"\S+",
    },
    entry_start=r"^\d{2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2}:\d{2}",
    samples=(Sample("01-Mar-2024 08:00:00.125 SEVERE [main] a.b.Valve.invoke broken pipe", "SEVERE"),),
)

TOMCAT_ACCESS = LogSchema(
    name="Tomcat Access Log",
    template='<remote_host> <ident> <remote_user> [<timestamp>] "<request>" <status> <bytes><extra?>',
    time_format="%d/%b/%Y:%H:%M:%S %z",
    field_patterns={
        "remote_host": r"\S+",
        "ident": r"\S+",
        "remote_user": r"\S+",
        "timestamp": r"[^\]]+",
        "status": r"\d{3}",
        "bytes": r"[\d-]+",
        "extra": " .*",
    },
    entry_start=r"^\S+ \S+ \S+ \[",
    samples=(Sample('10.1.2.3 - ann [01/Mar/2024:08:00:00 +0100] "GET /shop HTTP/1.1" 200 17'),),
)

LOG4J2 = LogSchema(
    name="Log4j2 Default",
    template="<timestamp> [<thread>] <level><levelpad> <module> - <message>",
    time_format="%Y-%m-%d %H:%M:%S,%3f",
    field_patterns={
        "timestamp": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}",
        "thread": r"[^\]]*",
        "level": "[A-Z]+",
        "levelpad": " *",
        "module": r"\S+",
    },
    entry_start=r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}",
    samples=(Sample("2024-03-01 08:00:00,125 [main] DEBUG a.b.Shop - restocked", "DEBUG"),),
)

BUNDLED = (SPRING_BOOT, SPRING_BOOT_3, TOMCAT_CATALINA, TOMCAT_ACCESS, LOG4J2)
BUILTIN = (BRACKETED, GENERIC)
ALL_SCHEMAS = BUILTIN + BUNDLED

# Query texts of the shipped searches.
SAVED_SEARCHES = {
    "Authentication failures": (
        "/auth|login|signin|token|oauth|saml|ldap/ "
        "/fail(ed|ure)?|denied|invalid|unauthorized|forbidden|401|403/"
    ),
    "Database connection exhaustion": (
        "/database|db|jdbc|sql|postgres|mysql|oracle/ /connection|pool/ "
        "/exhausted|timeout|timed[[:space:]]*out|max(ed)?[[:space:]]*out|too[[:space:]]+many|refused/"
    ),
    "Kubernetes restart patterns": (
        "/kubernetes|k8s|pod|container|kubelet/ "
        "/restart|restarted|crashloopbackoff|oomkilled|back-off|liveness|readiness/"
    ),
    "Java exception chains": (
        "/exception|caused[[:space:]]+by|stacktrace|java[.]|javax[.]|org[.]springframework/"
    ),
    "Request-ID tracing": (
        "/request[-_]?id|trace[-_]?id|correlation[-_]?id|x-request-id|span[-_]?id/"
    ),
}
