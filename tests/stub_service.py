"""A service in a folder, for tests: item ``n`` is the file ``n``, its lines are its records; what is asked is written down, and failures are made to order."""

import os


class Folder:
    def __init__(self, options):
        self.at, self.fail = options["folder"], int(options.get("fail", "0"))

    def _log(self, what):
        with open(os.path.join(self.at, "log"), "a") as f:
            f.write(what + "\n")

    def exists(self, number):
        self._log(f"exists {number}")
        return os.path.exists(os.path.join(self.at, str(number)))

    def fetch(self, number):
        tries = os.path.join(self.at, f"tries-{number}")
        with open(tries, "a") as f:
            f.write("x")
        if os.path.getsize(tries) <= self.fail:
            raise OSError("try again")
        self._log(f"fetch {number}")
        with open(os.path.join(self.at, str(number))) as f:
            return f.read().splitlines()
