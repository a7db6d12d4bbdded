"""Names, patterns, tables and limits that results depend on."""

from __future__ import annotations

# Limits.
TREE_DEPTH = 20
SCENARIO_DEPTH = 10
DIRECTORY_DEPTH = 10
SOLVER_ROUNDS = 1000
SEARCH_ROWS = 50
PALETTE_ROWS, PALETTE_COMMANDS = 30, 15
RECENT_FILES, NAVIGATION_STEPS, CACHE_ENTRIES = 10, 50, 100

# Asynchronous mechanisms (kind, flag, context, bind patterns, trigger patterns). In a bind pattern the last
# group is the handler; the first of two groups is the variable.
_V = r"&?([\w\.\->]+)"
ASYNC_PATTERNS = [
    ("WorkQueue", False, "Process", [rf"INIT_WORK\s*\(\s*{_V}\s*,\s*(\w+)\s*\)"], [rf"schedule_work\s*\(\s*{_V}\s*\)", rf"queue_work\s*\([^,]+,\s*{_V}\s*\)"]),
    ("WorkQueue", True, "Process", [rf"INIT_DELAYED_WORK\s*\(\s*{_V}\s*,\s*(\w+)\s*\)"], [rf"schedule_delayed_work\s*\(\s*{_V}\s*,"]),
    ("Timer", False, "SoftIrq", [rf"timer_setup\s*\(\s*{_V}\s*,\s*(\w+)\s*,", r"DEFINE_TIMER\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)"], [rf"mod_timer\s*\(\s*{_V}\s*,", rf"add_timer\s*\(\s*{_V}\s*\)"]),
    ("Timer", True, "HardIrq", [r"([\w\.\->]+)\.function\s*=\s*(\w+)"], [rf"hrtimer_start\s*\(\s*{_V}\s*,"]),
    ("Interrupt", False, "HardIrq", [r"request_irq\s*\([^,]+,\s*(\w+)\s*,", r"devm_request_irq\s*\([^,]+,\s*[^,]+,\s*(\w+)\s*,"], []),
    ("Interrupt", True, "Process", [r"request_threaded_irq\s*\([^,]+,\s*\w+\s*,\s*(\w+)\s*,"], []),
    ("Tasklet", False, "SoftIrq", [rf"tasklet_init\s*\(\s*{_V}\s*,\s*(\w+)\s*,", r"DECLARE_TASKLET\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)"], [rf"tasklet_schedule\s*\(\s*{_V}\s*\)"]),
    ("KThread", False, "Process", [r"kthread_run\s*\(\s*(\w+)\s*,", r"kthread_create\s*\(\s*(\w+)\s*,"], [r"wake_up_process\s*\("]),
    ("RcuCallback", False, "SoftIrq", [rf"call_rcu\s*\(\s*{_V}\s*,\s*(\w+)\s*\)", rf"call_rcu_sched\s*\(\s*{_V}\s*,\s*(\w+)\s*\)"], []),
    ("Notifier", False, "Process", [rf"register_reboot_notifier\s*\(\s*{_V}\s*\)", rf"register_netdevice_notifier\s*\(\s*{_V}\s*\)", rf"blocking_notifier_chain_register\s*\([^,]+,\s*{_V}\s*\)", rf"atomic_notifier_chain_register\s*\([^,]+,\s*{_V}\s*\)"], []),
    ("Softirq", False, "SoftIrq", [r"open_softirq\s*\(\s*\w+\s*,\s*(\w+)\s*\)"], [r"raise_softirq\s*\(", r"raise_softirq_irqoff\s*\("]),
    ("completion", False, "Process", [rf"init_completion\s*\(\s*{_V}\s*\)", r"DECLARE_COMPLETION\s*\(\s*(\w+)\s*\)", rf"reinit_completion\s*\(\s*{_V}\s*\)"], [rf"complete\s*\(\s*{_V}\s*\)", rf"complete_all\s*\(\s*{_V}\s*\)"]),
    ("waitqueue", False, "Process", [rf"init_waitqueue_head\s*\(\s*{_V}\s*\)", r"DECLARE_WAIT_QUEUE_HEAD\s*\(\s*(\w+)\s*\)"], [rf"wake_up\s*\(\s*{_V}\s*\)", rf"wake_up_interruptible\s*\(\s*{_V}\s*\)", rf"wake_up_all\s*\(\s*{_V}\s*\)"]),
    ("WorkQueue", False, "Process", [rf"INIT_WORK_ONSTACK\s*\(\s*{_V}\s*,\s*(\w+)\s*\)"], [rf"schedule_work_on\s*\([^,]+,\s*{_V}\s*\)", rf"queue_work_on\s*\([^,]+,\s*[^,]+,\s*{_V}\s*\)", rf"flush_work\s*\(\s*{_V}\s*\)"]),
    ("irq_work", False, "HardIrq", [rf"init_irq_work\s*\(\s*{_V}\s*,\s*(\w+)\s*\)"], [rf"irq_work_queue\s*\(\s*{_V}\s*\)"]),
]

# Fields of operation tables that are callbacks.
OPS_FIELDS = {
    "file_operations": ["open", "read", "write", "release", "unlocked_ioctl", "mmap", "poll", "llseek"],
    "usb_driver": ["probe", "disconnect", "suspend", "resume"],
    "platform_driver": ["probe", "remove", "shutdown"],
    "i2c_driver": ["probe", "remove"],
    "net_device_ops": ["ndo_open", "ndo_stop", "ndo_start_xmit", "ndo_get_stats64", "ndo_set_mac_address"],
    "block_device_operations": ["open", "release", "ioctl"],
}

# Parts of names, compared in lower case.
REGISTER_NAMES = ["register", "subscribe", "connect", "bind", "attach", "add_handler", "set_callback", "on_", "listen"]
QUEUE_NAMES = ["queue_work", "schedule_work", "schedule_delayed_work", "enqueue", "push", "add_task", "submit", "kthread_queue_work", "queue_delayed_work", "tasklet_schedule", "tasklet_hi_schedule"]
SIGNAL_NAMES = ["connect", "signal_connect", "g_signal_connect", "on", "bind", "subscribe", "attach_handler", "add_signal_handler", "notify_register"]
CALLBACK_FIELDS = ["callback", "handler", "func", "fn", "ops", "probe", "remove", "open", "close", "read", "write", "init", "exit", "start", "stop", "notify"]

# What the classifier knows.
KNOWN_MECHANISMS = ["INIT_WORK", "INIT_DELAYED_WORK", "timer_setup", "setup_timer", "tasklet_init", "request_irq", "request_threaded_irq", "kthread_create"]
KNOWN_OPS = ["file_operations", "usb_driver", "i2c_driver", "platform_driver", "pci_driver"]
REASONS = [
    ("DirectCall", "Certain", "Direct function call"),
    ("KnownAsyncMechanism", "Certain", "Known async mechanism: "),
    ("OpsTableAssignment", "Certain", "Ops table assignment: "),
    ("VariableAssignment", "Certain", "Variable assignment"),
    ("ConditionalAssignment", "Possible", "Conditional assignment"),
    ("ArrayIndex", "Possible", "Array index access"),
    ("ExternalLibrary", "Unknown", "External library: "),
    ("ComplexIndirectCall", "Unknown", "Complex indirect call"),
    ("UserAnnotation", "Certain", "User annotation"),
]

# Integer types that are interchangeable.
INTEGER_TYPES = ["int", "long", "unsigned", "unsigned int", "unsigned long", "size_t", "ssize_t"]

# Built-in call chains (chain, trigger, context, functions and files; the last is the place of the user's function).
CHAINS = [
    ("usb_driver.probe", "USB device plugged in", "Process", [("usb_hub_port_connect", "drivers/usb/core/hub.c"), ("usb_new_device", "drivers/usb/core/hub.c"), ("device_add", "drivers/base/core.c"), ("bus_probe_device", "drivers/base/bus.c"), ("__device_attach", "drivers/base/dd.c"), ("driver_probe_device", "drivers/base/dd.c"), ("really_probe", "drivers/base/dd.c"), ("usb_probe_interface", "drivers/usb/core/driver.c"), ("drv->probe()", None)]),
    ("usb_driver.disconnect", "USB device unplugged or driver unloaded", "Process", [("usb_hub_port_disconnect", "drivers/usb/core/hub.c"), ("usb_disconnect", "drivers/usb/core/hub.c"), ("device_del", "drivers/base/core.c"), ("__device_release_driver", "drivers/base/dd.c"), ("usb_unbind_interface", "drivers/usb/core/driver.c"), ("drv->disconnect()", None)]),
    ("file_operations.open", "open() system call", "Process", [("sys_open / sys_openat", "fs/open.c"), ("do_sys_open", "fs/open.c"), ("do_filp_open", "fs/namei.c"), ("vfs_open", "fs/open.c"), ("do_dentry_open", "fs/open.c"), ("f->f_op->open()", None)]),
    ("work_struct", "kworker thread scheduled", "Process", [("kworker/xxx", "kernel/workqueue.c"), ("worker_thread", "kernel/workqueue.c"), ("process_one_work", "kernel/workqueue.c"), ("worker->current_func", "kernel/workqueue.c"), ("work->func()", None)]),
    ("timer_list", "timer expired", "SoftIrq", [("timer interrupt", "kernel/time/timer.c"), ("run_timer_softirq", "kernel/time/timer.c"), ("__run_timers", "kernel/time/timer.c"), ("call_timer_fn", "kernel/time/timer.c"), ("timer->function()", None)]),
    ("work_struct.irq", "hardware interrupt", "HardIrq", [("do_IRQ", "arch/x86/kernel/irq.c"), ("handle_irq", "kernel/irq/handle.c"), ("irq_handler()", None)]),
]
CALLBACKS = [
    ("usb_driver", "probe", "Called when a USB device matching the ID table is connected", "int (*)(struct usb_interface *, const struct usb_device_id *)", "usb_driver.probe"),
    ("usb_driver", "disconnect", "Called when the USB device is disconnected", "void (*)(struct usb_interface *)", "usb_driver.disconnect"),
    ("file_operations", "open", "Called when the device is opened", "int (*)(struct inode *, struct file *)", "file_operations.open"),
    ("file_operations", "read", "Called to read from the device", "ssize_t (*)(struct file *, char __user *, size_t, loff_t *)", None),
    ("file_operations", "write", "Called to write to the device", "ssize_t (*)(struct file *, const char __user *, size_t, loff_t *)", None),
]
#: (api, description, can sleep, can fail, parameters)
KERNEL_APIS = [
    ("kzalloc", "Allocate zeroed kernel memory", True, True, ["size", "gfp_flags"]),
    ("kfree", "Free kernel memory", False, False, ["ptr"]),
    ("mutex_lock", "Acquire a mutex", True, False, ["mutex"]),
    ("spin_lock", "Acquire a spinlock", False, False, ["lock"]),
    ("printk", "Print a kernel message", False, False, ["fmt", "..."]),
]
#: Chain of the handlers of a mechanism.
MECHANISM_CHAIN = {"WorkQueue": "work_struct", "Timer": "timer_list"}

# Target architectures (name, triple, source directory, macros as name=value, names it is given by).
ARCHITECTURES = [
    ("x86_64", "x86_64-linux-gnu", "x86", ["__x86_64__", "__amd64__", "__LP64__=1"], ["x86_64", "amd64"]),
    ("i386", "i386-linux-gnu", "x86", ["__i386__", "__i686__"], ["i386", "i686", "x86"]),
    ("arm64", "aarch64-linux-gnu", "arm64", ["__aarch64__", "__LP64__=1"], ["arm64", "aarch64"]),
    ("arm", "arm-linux-gnueabi", "arm", ["__arm__"], ["arm", "arm32"]),
    ("riscv64", "riscv64-linux-gnu", "riscv", ["__riscv", "__riscv_xlen=64", "__LP64__=1"], ["riscv64"]),
    ("riscv32", "riscv32-linux-gnu", "riscv", ["__riscv", "__riscv_xlen=32"], ["riscv32", "riscv"]),
    ("mips", "mips-linux-gnu", "mips", ["__mips__"], ["mips"]),
    ("powerpc", "powerpc64-linux-gnu", "powerpc", ["__powerpc__", "__powerpc64__"], ["powerpc", "ppc64"]),
]

# Prefixes of kernel functions.
KERNEL_PREFIXES = ["kmalloc", "kzalloc", "kcalloc", "kfree", "vmalloc", "vzalloc", "vfree", "spin_lock", "spin_unlock", "mutex_lock", "mutex_unlock", "printk", "pr_", "dev_", "container_of", "list_"]

# How a confidence is shown (symbol, style class, arrow).
CONFIDENCES = [
    ("Certain", "✓", "result-certain", "solid"),
    ("Possible", "?", "result-possible", "dashed"),
    ("Unknown", "❓", "result-unknown", "dotted"),
]

# How asynchronous mechanisms are shown (kind, flag, flag's name, icon, name, tag).
MECHANISMS = [
    ("WorkQueue", False, "delayed", "⚙️", "WorkQueue", "WQ"),
    ("WorkQueue", True, "delayed", "⚙️", "DelayedWork", "DW"),
    ("Timer", False, "high_resolution", "⏲️", "Timer", "TM"),
    ("Timer", True, "high_resolution", "⏲️", "HRTimer", "HR"),
    ("Interrupt", False, "threaded", "⚡", "IRQ", "IRQ"),
    ("Interrupt", True, "threaded", "⚡", "ThreadedIRQ", "TI"),
    ("Tasklet", False, None, "🔄", "Tasklet", "TL"),
    ("Softirq", False, None, "⚡", "SoftIRQ", "SI"),
    ("KThread", False, None, "🧵", "KThread", "KT"),
    ("RcuCallback", False, None, "🔒", "RCU", "RCU"),
    ("Notifier", False, None, "📢", "Notifier", "NF"),
]
OTHER_MECHANISM_ICON = "📍"

# Icon and class of a node (type, icon, class).
NODES = [
    ("Function", "📦", "function"),
    ("EntryPoint", "🚀", "entry"),
    ("KernelApi", "⚙️", "kernel"),
    ("External", "🔗", "external"),
    ("AsyncCallback", "⚡", "async"),
]

# Kinds of outline items in order, with the titles of their sections.
OUTLINE_KINDS = [("function", "Functions"), ("struct", "Structures"), ("variable", "Variables"), ("macro", "Macros"), ("enum", "Enums"), ("typedef", "Typedefs")]

# Kinds of calls in all languages (kind, group, whether the callee is known at the call).
CALL_KINDS = [
    ("Direct", "sync", True),
    ("Method", "sync", True),
    ("VirtualMethod", "sync", False),
    ("StaticMethod", "sync", True),
    ("FunctionPointer", "sync", False),
    ("Callback", "sync", False),
    ("Constructor", "sync", True),
    ("Closure", "sync", False),
    ("Goroutine", "async", True),
    ("CoroutineLaunch", "async", True),
    ("ExecutorSubmit", "async", True),
    ("TokioSpawn", "async", True),
    ("Promise", "async", True),
    ("KernelWorkQueue", "async", True),
    ("Generic", "async", True),
]

# Files that tell a kernel tree, its subsystems, include folders ({arch} is the architecture's) and macros.
KERNEL_MARKERS = ["Kconfig", "Makefile", "include/linux/kernel.h", "arch/x86/Kconfig"]
KERNEL_SUBSYSTEMS = ["drivers", "fs", "net", "kernel", "mm", "block", "sound", "crypto", "security"]
KERNEL_INCLUDES = [
    "include", "include/uapi", "arch/{arch}/include", "arch/{arch}/include/uapi", "arch/{arch}/include/generated",
    "arch/{arch}/include/generated/uapi", "include/generated", "include/generated/uapi",
]
KERNEL_MACROS = [("__KERNEL__", None), ("__GNUC__", "12"), ("__GNUC_MINOR__", "0")]
KERNEL_ARGUMENTS = ["-nostdinc", "-fno-builtin"]
MAKEFILE_LINES = 10
DRIVER_FILES = 100

# An assignment to a member, and a static table of members.
ASSIGNMENT = r"(\w+(?:\.\w+|->+\w+)*)\s*=\s*(\w+)\s*;"

# Type letters of native-method signatures.
NATIVE_TYPES = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double", "V": "void"}

# Places of nodes in a layered drawing, and how the drawing opens and folds.
NODE_WIDTH, NODE_HEIGHT, RANK_SPACING, NODE_SPACING = 180, 40, 80, 20
EXPAND_BELOW, COLLAPSE_ABOVE, SHOWN_DEPTH = 3, 10, 5
