"""What the command line offers besides its verbs: a banner, completion scripts and an interactive prompt.

Verbs and flags are read from the argument parser, so that all three follow it.
"""

from __future__ import annotations

import argparse
import contextlib
import datetime
import glob
import os
import shlex
import sys
from collections.abc import Callable

from . import __version__

SHELLS = ("bash", "zsh", "fish")
HISTORY, HISTORY_LINES = "~/.readweft/history", 1000


def verbs(parser: argparse.ArgumentParser) -> dict[str, tuple[str, list[str]]]:
    """Help and flags of each verb."""
    (choice,) = (a for a in parser._actions if isinstance(a, argparse._SubParsersAction))
    about = {a.dest: a.help or "" for a in choice._choices_actions}
    return {name: (about[name], sorted(f for a in p._actions for f in a.option_strings if f.startswith("--"))) for name, p in choice.choices.items()}


def completions(parser: argparse.ArgumentParser, shell: str) -> str:
    """The script that completes verbs, their flags and file names."""
    name, own = parser.prog, verbs(parser)
    if shell == "fish":
        lines = [f"complete -c {name} -n __fish_use_subcommand -f -a {v} -d {shlex.quote(about)}" for v, (about, _) in own.items()]
        lines += [f"complete -c {name} -n '__fish_seen_subcommand_from {v}' -l {flag[2:]}" for v, (_, flags) in own.items() for flag in flags]
        return "\n".join(lines) + "\n"
    cases = "\n".join(f'    {v}) words="{" ".join(flags)}" ;;' for v, (_, flags) in own.items())
    head = f"#compdef {name}\nautoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    return f"""{head}_{name}() {{
  local now="${{COMP_WORDS[COMP_CWORD]}}" words=""
  if [ "$COMP_CWORD" -eq 1 ]; then
    COMPREPLY=($(compgen -W "{" ".join(own)}" -- "$now"))
    return
  fi
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  case "$now" in
    -*) COMPREPLY=($(compgen -W "$words" -- "$now")) ;;
    *) COMPREPLY=($(compgen -f -- "$now")) ;;
  esac
}}
complete -o filenames -F _{name} {name}
"""


def build_date() -> str:
    """The day on which the newest file of the package was written, in UTC."""
    own = glob.glob(os.path.join(os.path.dirname(os.path.abspath(__file__)), "**", "*.py"), recursive=True)
    return datetime.datetime.fromtimestamp(max(map(os.path.getmtime, own)), datetime.UTC).date().isoformat()


def banner() -> str:
    bold, plain = ("\x1b[1m", "\x1b[0m") if sys.stderr.isatty() else ("", "")
    return f"\n{bold}readweft: sequencing reads on Spark{plain}\n\n  Version:     {__version__}\n  Build date:  {build_date()}\n\nreadweft --help shows the commands.\n"


def candidates(parser: argparse.ArgumentParser, line: str, word: str) -> list[str]:
    """What may stand in place of the word that ends the line."""
    before = line[: len(line) - len(word)].split()
    own = verbs(parser)
    if not before:
        return [v + " " for v in own if v.startswith(word)]
    if word.startswith("-"):
        return [f + " " for f in own.get(before[0], ("", []))[1] if f.startswith(word)]
    return sorted(p + ("/" if os.path.isdir(p) else " ") for p in glob.glob(glob.escape(word) + "*"))


def one_line(parser: argparse.ArgumentParser, line: str, run: Callable[[list[str]], int]) -> bool:
    """Runs what was typed; errors are told and the session goes on. False to leave."""
    line = line.strip()
    if line in ("exit", "quit"):
        return False
    if line == "help":
        print("\n".join(f"  {v:<12} {about}" for v, (about, _) in verbs(parser).items()))
    elif line:
        try:
            argv = shlex.split(line)
            with contextlib.suppress(SystemExit):  # the parser has said what is wrong
                if parser.parse_args(argv).verb:
                    run(argv)
        except Exception as e:
            print(f"error: {e}", file=sys.stderr)
    return True


def interactive(parser: argparse.ArgumentParser, run: Callable[[list[str]], int]) -> None:
    """A prompt with completion and a history under the home folder, until exit, quit or the end of the input."""
    print("Type a command, help for a list of them, exit to leave.", file=sys.stderr)
    path = os.path.expanduser(HISTORY)
    try:
        import readline
    except ImportError:
        readline = None
    if readline:
        readline.set_completer_delims(" \t\n")
        readline.set_completer(lambda word, k: (candidates(parser, readline.get_line_buffer()[: readline.get_endidx()], word) + [None])[k])
        readline.parse_and_bind("tab: complete")
        readline.set_history_length(HISTORY_LINES)
        with contextlib.suppress(OSError):
            readline.read_history_file(path)
    while True:
        try:
            if not one_line(parser, input("readweft> "), run):
                break
        except KeyboardInterrupt:
            print()
        except EOFError:
            break
    if readline:
        with contextlib.suppress(OSError):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            readline.write_history_file(path)
