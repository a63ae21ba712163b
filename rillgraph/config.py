"""The option surface, as one typed object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AnalysisConfig:
    """Every option with its default; names are the options' with underscores."""

    path_sens: bool = False
    import_bugs: str = ""
    export_bugs: str = ""
    uar_sinks: str = "kernel_delete_funcs.txt"
    uar_timeout: int = 11
    uarl_sinks: str = ""
    uarl_timeout: int = 10
    func_limit: int = 3000
    initcall_contexts: str = "initcall_contexts.txt"
    syscall: str = ""
    driver: str = ""
    rm_deref: bool = False
    mssa_ignoreDeadFun: bool = False
    dump_mssa: bool = False
    mssafun: str = ""
    mempar: str = "intra-disjoint"
    dump_svfg: bool = False
    svfgIndCallPreAna: bool = False
    ci_svfg: bool = False
    keep_self_cycle: str = ""
    dump_consG: bool = False
    stride_only: bool = False
    fieldlimit: int = 10_000
    locMM: bool = False
    vgep: bool = False
    blk: bool = False
    print_type: bool = False
    print_fp: bool = False
    print_pts: bool = False
    print_all_pts: bool = False
    stat: bool = True
    statlimit: int = 20
    dump_pag: bool = False
    print_pag: bool = False
    graphtxt: str = ""
    indCallLimit: int = 50_000
    preFieldSensitive: bool = True
    alias_check: bool = True
    enable_tcg: bool = True
    incdata: bool = True
    valid_tests: bool = False
    dump_slice: bool = False
    cxtlimit: int = 3
    dwarn: bool = True
    maxbddsize: int = 100_000
    dump_callgraph: bool = False
    print_pc: bool = False
    pointer_analysis: tuple[str, ...] = ("wander",)
    alias_rule: str = "conservative"
    cg_ignore: str = ""
    report: str = ""
    monitor_system: bool = False
    leak: bool = False
    use_after_free: bool = False
    use_after_return: bool = False
    use_after_return_lite: bool = False
    double_lock: bool = False
    fileck: bool = False
    double_free: bool = False
    dump_syscallstat: bool = False
    num_threads: int = 1
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.syscall and self.driver:
            raise ValueError("only one of syscall and driver can be the interface")

    @property
    def checkers(self) -> list[str]:
        """The checkers asked for, in the order in which they run."""
        return [c for c in ("use_after_return", "use_after_return_lite", "leak", "use_after_free", "double_free", "double_lock") if getattr(self, c)]
